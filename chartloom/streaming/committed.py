"""A result store in which a run counts once it is committed.

``attempts/attempt=.../`` holds the rows of one try of a run as Parquet,
``commits`` one small JSON row for each finished run: its id, the try that
counts, the number of rows and the time. Rows become visible only through their
commit, so a run killed while or after writing its rows leaves nothing behind
that is read, and it is simply run again. A run that is already committed is
not repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.operators import export
from chartloom.schemas import ADJUDICATION
from chartloom.sources import sinks, tables
from chartloom.streaming.incremental import pending

COMMIT = "run_id string, attempt string, row_count bigint, run_ts string"


def _read(spark: SparkSession, read: Callable[[], DataFrame], schema: str | T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def commits(spark: SparkSession, store: str) -> DataFrame:
    """One row per committed run. Should two writers commit the same run, the smaller attempt counts."""
    rows = _read(spark, lambda: spark.read.schema(COMMIT).json(f"{store}/commits"), COMMIT)
    first = F.min(F.struct("attempt", "row_count", "run_ts")).alias("first")
    return rows.groupBy("run_id").agg(first).select("run_id", "first.*")


def _attempts(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    return _read(spark, lambda: spark.read.schema(whole).parquet(f"{store}/attempts"), whole)


def results(spark: SparkSession, store: str, schema: T.StructType = ADJUDICATION) -> DataFrame:
    """Rows of all committed runs with their ``run_id``; folders of other tries are pruned."""
    counted = commits(spark, store).select("run_id", "attempt")
    return _attempts(spark, store, schema).join(counted, "attempt").select("run_id", *schema.fieldNames())


def write_attempt(df: DataFrame, store: str, schema: T.StructType = ADJUDICATION) -> str:
    """Write the rows of a run; nobody reads them before ``commit``."""
    attempt = uuid.uuid4().hex
    df.select(*schema.fieldNames()).write.parquet(f"{store}/attempts/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, store: str, run_id: str, attempt: str, run_ts: str) -> None:
    """Make a written try the result of its run. One row in one file, so it is there whole or not at all."""
    rows = spark.read.parquet(f"{store}/attempts/attempt={attempt}").count()
    sinks.append_json(spark.createDataFrame([(run_id, attempt, rows, run_ts)], COMMIT).coalesce(1), f"{store}/commits")


def append_run(df: DataFrame, store: str, run_id: str, run_ts: str, schema: T.StructType = ADJUDICATION) -> bool:
    """Write and commit a run; False, and nothing is written, if it was committed before."""
    spark = df.sparkSession
    if not commits(spark, store).filter(F.col("run_id") == run_id).isEmpty():
        return False
    commit(spark, store, run_id, write_attempt(df, store, schema), run_ts)
    return True


def run(charts: DataFrame, store: str, decide: Callable[[DataFrame], DataFrame], run_id: str, run_ts: str) -> DataFrame:
    """Decide the visits without a committed result, commit them as ``run_id``, and return the counts per status.

    To learn what is done, only the id column of committed rows is read.
    """
    spark = charts.sparkSession
    append_run(decide(pending(charts, results(spark, store))), store, run_id, run_ts)
    return export.status_counts(results(spark, store))


def adopt_history(spark: SparkSession, json_path: str, store: str, run_id: str, run_ts: str) -> bool:
    """Take a JSON lines history over as one run; its broken lines are skipped, and it is parsed this once."""
    return append_run(tables.read_json_lines(spark, json_path, ADJUDICATION)[0], store, run_id, run_ts)


def abandoned(spark: SparkSession, store: str) -> DataFrame:
    """Tries that no commit names: what killed runs left and a caller may delete once no run is active."""
    tries = _attempts(spark, store, T.StructType()).select("attempt").distinct()
    return tries.join(commits(spark, store), "attempt", "left_anti")
