"""Ordered work on groups of any size.

One visit, patient or source may hold a third of all rows, so no helper here
sorts or collects a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import reliable_checkpoint


def first_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Sequence[str] = (),
    pieces: int = 32,
    rank: str | None = None,
) -> DataFrame:
    """Keep the first ``n`` rows of every key.

    Spark already keeps only ``n`` rows per key and map task before the shuffle.
    With ``spread`` columns (wide rows) a first pass ranks each key in
    ``pieces`` parts, so the last pass sees at most ``pieces * n`` rows per key.
    """
    if spread:
        part = F.pmod(F.xxhash64(*spread), F.lit(pieces))
        inner = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_place", F.row_number().over(inner))
            .filter(F.col("_place") <= n)
            .drop("_part", "_place")
        )
    outer = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn("_place", F.row_number().over(outer)).filter(F.col("_place") <= n)
    return kept.withColumnRenamed("_place", rank) if rank else kept.drop("_place")


def never_broadcast(df: DataFrame) -> DataFrame:
    """Rows that Spark sizes like their compressed source, though exploding or narrowing made them many: joins merge them."""
    return df.hint("merge")


def number_rows(
    df: DataFrame,
    order: Sequence[Column],
    chunk: Column,
    name: str,
    keys: Sequence[str] = (),
    first: int = 1,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Number rows without gaps in ``order``, without one task seeing them all.

    ``chunk`` must not be null and must grow with ``order``. Rows are numbered
    inside their chunk; the chunk starts come from a count per chunk. A caller that
    has counted already gives the counts as ``sizes`` (keys, ``_chunk``, ``_rows``);
    rows of chunks that it leaves out are dropped, its other columns are added.
    """
    parts = df.withColumn("_chunk", chunk)
    running = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    if sizes is None:
        sizes = parts.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    starts = (
        sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(running), F.lit(0)))
        .drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        parts.join(starts, [*keys, "_chunk"])
        .withColumn(name, F.col("_start") + F.row_number().over(inside) + F.lit(first - 1))
        .drop("_chunk", "_start")
    )


def join_spread(big: DataFrame, small: DataFrame, keys: Sequence[str], by: Column, pieces: int = 16) -> DataFrame:
    """Inner join where one key may own a large share of ``big``.

    Rows of ``big`` are spread over ``pieces`` by ``by``; the rows of ``small``
    (one per key) are repeated once per piece. The column ``_piece`` stays, so
    that a grouping which includes it needs no further shuffle.
    """
    spread = big.withColumn("_piece", F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int"))
    copies = small.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return spread.join(copies, [*keys, "_piece"])


#: Rows of one key that a single task may put in order.
CROWD = 50_000


@dataclass
class Crowd:
    """Keys with too many rows for one task: a few keys, or None where there are none."""

    keys: list[str]
    found: DataFrame | None

    def marked(self, df: DataFrame) -> DataFrame:
        """The rows with ``_crowded``."""
        if self.found is None:
            return df.withColumn("_crowded", F.lit(False))
        joined = df.join(F.broadcast(self.found.withColumn("_found", F.lit(True))), self.keys, "left")
        return joined.withColumn("_crowded", F.col("_found").isNotNull()).drop("_found")

    def only(self, df: DataFrame) -> DataFrame:
        return df.limit(0) if self.found is None else df.join(F.broadcast(self.found), self.keys, "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        return df if self.found is None else df.join(F.broadcast(self.found), self.keys, "left_anti")


def crowded_keys(rows: DataFrame, keys: Sequence[str], count: Column | None = None) -> Crowd:
    """Keys with more than ``CROWD`` rows: few, as each of them has so many."""
    counts = rows.groupBy(*keys).agg((F.count(F.lit(1)) if count is None else count).alias("_rows"))
    found = reliable_checkpoint(counts.filter(F.col("_rows") > CROWD).select(*keys))
    return Crowd(list(keys), None if found.isEmpty() else found)


def join_together(big: DataFrame, small: DataFrame, by: Column, crowd: Crowd, pieces: int = 16) -> DataFrame:
    """Inner join that leaves the rows of a key in one place and spreads crowded keys by ``by``.

    ``small`` has a narrow row per key, so each task keeps its share at hand and
    the rows of ``big`` are not sorted. They come out dealt by the keys and
    ``_piece``: what is grouped or ordered by these afterwards is not shuffled again.
    """
    place = F.pmod(F.xxhash64(by), F.lit(pieces)).cast("int")
    spread = crowd.marked(big).withColumn("_piece", F.when(F.col("_crowded"), place).otherwise(0)).drop("_crowded")
    if crowd.found is None:
        return spread.join(small.hint("shuffle_hash"), crowd.keys)
    every = F.when(F.col("_crowded"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    copies = crowd.marked(small).withColumn("_piece", F.explode(every)).drop("_crowded")
    return spread.join(copies.hint("shuffle_hash"), [*crowd.keys, "_piece"])
