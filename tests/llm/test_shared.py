import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartloom.llm import shared


def test_smallest_takes_the_smallest_marks(spark):
    df = spark.range(100).select("id", (F.col("id") * 37 % 101).alias("mark"))
    assert sorted(r["mark"] for r in shared.smallest(df, F.col("mark"), 10).collect()) == sorted(i * 37 % 101 for i in range(100))[:10]
    same = spark.range(50).select(F.lit(1).cast("long").alias("mark"))
    assert shared.smallest(same, F.col("mark"), 10).count() == 10
    assert shared.smallest(df.limit(0), F.col("mark"), 10).count() == 0


def test_only_ascii_letters_are_lowered(spark):
    text = "AbZ ÀÉß İ"
    assert spark.range(1).select(shared.lower_ascii(F.lit(text)).alias("t")).first().t == "abz ÀÉß İ"
    assert spark.range(1).select(shared.lower_ascii(F.lit("ABC")).alias("t")).first().t == "abc"


def test_pieces_keep_all_rows():
    batch = pa.record_batch({"text": ["x" * n for n in (0, 10, 100_000, 5, 5)], "k": [1, 2, 3, 4, 5]})
    parts = list(shared.pieces(batch, 1000))
    assert [k for p in parts for k in p.column("k").to_pylist()] == [1, 2, 3, 4, 5]
    assert list(shared.pieces(batch.slice(0, 0), 1000)) == []


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert shared.shared_folder(spark).startswith("file:///")
    context = type(spark.sparkContext)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: None)
    monkeypatch.setattr(context, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError):
        shared.shared_folder(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "local[2]")
    assert shared.shared_folder(spark).startswith("file:///")
