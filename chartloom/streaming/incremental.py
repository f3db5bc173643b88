"""Adding results to a store run by run.

A run decides only the visits that have no result yet, appends them, and may be
repeated after a failure. There is no open-ended stream in this work: a run is a
batch over whatever is pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import export
from chartloom.schemas import ADJUDICATION
from chartloom.sources import sinks, tables


def pending(visits: DataFrame, done: DataFrame) -> DataFrame:
    """Visits without a result. Only ids of the results are read."""
    ids = done.select("visit_occurrence_id").filter(F.col("visit_occurrence_id").isNotNull())
    return visits.join(ids, "visit_occurrence_id", "left_anti")


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """Results so far; broken lines are skipped, a missing store is empty."""
    try:
        return tables.read_json_lines(spark, path, ADJUDICATION)[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ADJUDICATION)


def run_increment(
    charts: DataFrame, store: str, decide: Callable[[DataFrame], DataFrame], condition: str, run_ts: str,
    export_folder: str | None = None,
) -> DataFrame:
    """Decide the pending charts, append them, and return the counts per status.

    ``decide`` maps charts to adjudication rows: the rules, parsed answers, or a
    function of the caller run with ``mapInPandas``.
    """
    spark = charts.sparkSession
    todo = pending(charts, stored_results(spark, store))
    sinks.append_json(decide(todo).select(*ADJUDICATION.fieldNames()), store)
    results = stored_results(spark, store)
    if export_folder is not None:
        sinks.write_batch(results, export.observations(results, condition, run_ts), export_folder)
    return export.status_counts(results)


def decide_with(function, schema=ADJUDICATION) -> Callable[[DataFrame], DataFrame]:
    """A caller's batch function (pandas rows in, adjudication rows out) as a step.

    Spark feeds it Arrow batches on the executors; the batch size is
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    def step(charts: DataFrame) -> DataFrame:
        return charts.mapInPandas(lambda batches: (function(batch) for batch in batches), schema)

    return step


def append_audit(entries: DataFrame, path: str, run_ts: str) -> None:
    """Normalise audit entries and add them to the log."""
    sinks.append_json(export.normalize_audit(entries, run_ts), path)
