"""Helpers of the operators in this folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package wherever the driver was started.

    On a cluster the package is installed or sent with ``--py-files``; the path is harmless there.
    """
    root, environment = str(pathlib.Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Without that setting a temporary
    folder is used in local mode, where all tasks share the machine, and any
    other master is refused.
    """
    importable(spark)
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        context.setCheckpointDir(base)
    # With its scheme, the folder means the same to Spark and to Arrow's file systems in the tasks.
    path = context._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if whole.startswith("file:/"):
        whole = f"file:///{whole.removeprefix('file:').lstrip('/')}"
    return f"{whole.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a result that is read several times, and read it back."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Beyond this number a task reads several files or blocks, one after the other.
MOST_TASKS = 20_000


def tasks_for(items: int) -> int:
    """Tasks for a number of files or blocks that are read one at a time."""
    return min(max(items, 1), MOST_TASKS)


def texts_of(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and whole text, null counted as empty. Other columns are dropped, so none can clash."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra
    )


def smallest(df: DataFrame, mark: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest marks.

    Only marks are ordered and one of them reaches the driver, so wide rows are
    not moved. More rows than wanted share the last mark only if they repeat.
    """
    top = df.select(mark.alias("mark")).filter("mark IS NOT NULL").orderBy("mark").limit(rows).agg(F.max("mark")).first()[0]
    return df.filter(mark <= F.lit(top).cast("long")).limit(rows)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def batches_of(
    df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, bytes_a_batch: int = 16 << 20
) -> DataFrame:
    """Apply ``rows`` (record batch to columns) to batches whose texts together stay near ``bytes_a_batch``."""

    importable(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, bytes_a_batch):
                made = rows(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in out],
                    schema=out,
                )
        pa.default_memory_pool().release_unused()  # an idle worker holds no memory that other tasks need

    return df.mapInArrow(run, fields)


def pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``limit`` bytes; one row is never cut."""
    count = max(1, -(-batch.nbytes // limit))
    step = max(1, -(-batch.num_rows // count))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)
