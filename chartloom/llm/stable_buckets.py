"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one. A table hashes them by ``k`` random Gaussian
projections, each shifted and cut into cells of ``WIDTH``; vectors in one bucket
of any table are candidates. ``k`` follows from the number of vectors, so that a
bucket holds about ``OCCUPANCY`` unrelated ones, and the number of tables from
``k``, so that a pair at the threshold itself is missed with a chance of at most
``MISS`` (closer pairs far less). Within a bucket 128 random signs a vector sort
out the candidates; what is left is joined to the vectors and checked exactly.

Hot groups never become pairs. Equal vectors count as one with a weight. Where a
bucket is crowded (over ``CROWDED``), the densest spot of a bounded sample of it
becomes a centre; vectors within half the threshold's angle of a centre form a
ball, all of whose members link by the triangle inequality. A ball stands for its
members in every bucket. Two balls (or a ball and a vector) whose angle is small or
large enough for all their members are settled as a whole; only the others are
taken apart, exactly. Buckets that are still large are compared block by block.

Defined results: null, empty or zero vectors and those with null or non-finite
components link with nothing; vectors of different length never link; repeated
rows are vectors of their own; a null vec_id takes part, and names a component only
if no other id is in it; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import batches_of, importable, shared_folder, stored
from chartloom.llm.simhash_cover import components

COSINE = 0.9
WIDTH = 2.0
#: Unrelated vectors expected in a bucket, and members from which on a bucket is crowded.
OCCUPANCY, CROWDED = 64, 128
MISS = 0.002
#: Members of a crowded bucket that are looked at for its centre (expected number).
SAMPLE = 256
#: Rows of a bucket that are compared in one task.
TOGETHER = 4096
SIGNS = 128
SEED = 20


def agreement(distance: float) -> float:
    """Chance that one projection puts two vectors of this distance into one cell."""
    ratio = WIDTH / distance
    tail = math.erfc(ratio / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


def plan_of(count: int, cosine: float = COSINE) -> tuple[int, int]:
    """Projections a table, and tables, for so many vectors."""
    k = max(4, math.ceil(math.log(max(count, OCCUPANCY) / OCCUPANCY) / -math.log(agreement(math.sqrt(2)))))
    return k, math.ceil(math.log(MISS) / math.log(1 - agreement(math.sqrt(2 - 2 * cosine)) ** k))


@lru_cache(maxsize=4)
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Directions and shifts of all tables, directions of the signs, and odd multipliers that name a bucket."""
    rng = np.random.default_rng([SEED, dim])
    return (
        rng.normal(size=(dim, tables * k)), rng.uniform(0, WIDTH, tables * k), rng.normal(size=(dim, SIGNS)),
        rng.integers(1 << 62, size=(tables, k), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1),
    )


def hashes(unit: np.ndarray, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (row, table) and signs (row, 2) as longs. A bucket's name holds its table and the length of the vectors."""
    dim = unit.shape[1]
    directions, shifts, signs, odd = projections(dim, k, tables)
    cells = np.floor((unit @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(unit), tables, k)
    name = np.repeat((np.arange(tables, dtype=np.uint64) + np.uint64(dim << 16))[None] * np.uint64(0x9E3779B97F4A7C15), len(unit), 0)
    for i in range(k):
        name = (name ^ cells[:, :, i]) * odd[None, :, i]
        name ^= name >> np.uint64(29)
    return name.view(np.int64), np.packbits(unit @ signs > 0, axis=1).view(np.int64)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of an array column for every length in it."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[begin[rows][:, None] + np.arange(size)[None]]


def unit_of(vectors: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares from overflowing or vanishing.
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def signatures(vectors: DataFrame, k: int, tables: int) -> DataFrame:
    """Buckets and signs of rows (id, vec)."""

    def rows(batch: pa.RecordBatch) -> dict:
        names, signs = np.zeros((batch.num_rows, tables), np.int64), np.zeros((batch.num_rows, 2), np.int64)
        for at, own in by_length(batch.column("vec")):
            names[at], signs[at] = hashes(unit_of(own), k, tables)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(names.ravel()))
        return {"id": batch.column("id"), "buckets": lists, "s0": signs[:, 0], "s1": signs[:, 1]}

    return batches_of(vectors.select("id", "vec"), rows, "id long, buckets array<long>, s0 long, s1 long", 4 << 20)


def _densest(cosine: float):
    """For the sample of a bucket: the mean around the vector with most others within half the angle."""
    half = math.cos(math.acos(cosine) / 2)

    def run(key, table):
        best, kept = 0, None
        vec = table.column("vec").combine_chunks()
        for _, own in by_length(vec):
            unit = unit_of(own)
            near = unit @ unit.T >= half
            most = int(near.sum(1).argmax())
            if near[most].sum() > best:
                best, kept = int(near[most].sum()), unit[near[most]].mean(0)
        if best * 16 < table.num_rows:
            return pa.table({"size": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        return pa.table({"size": pa.array([table.column("size")[0].as_py()], pa.int64()), "vec": pa.array([kept.tolist()], pa.list_(pa.float64()))})

    return run


def _angles(batch: pa.RecordBatch, left: str = "vec", right: str = "other") -> tuple[np.ndarray, np.ndarray]:
    """Cosine and angle of the two vectors of every row; NaN if their lengths differ."""
    cosine = np.full(batch.num_rows, np.nan)
    same = np.diff(batch.column(left).offsets.to_numpy()) == np.diff(batch.column(right).offsets.to_numpy())
    rows = np.flatnonzero(same)
    if len(rows):
        a, b = (batch.column(c).take(pa.array(rows)) for c in (left, right))
        for (at, x), (_, y) in zip(by_length(a), by_length(b), strict=True):
            cosine[rows[at]] = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return cosine, np.arccos(np.clip(cosine, -1, 1))


def balls_of(vectors: DataFrame, signs: DataFrame, k: int, tables: int, cosine: float, folder: str, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame]:
    """Balls (id below 0, vec, r, weight, first) and their members (id, ball).

    All members of a ball lie within half the threshold's angle of its centre.
    """
    spread = signs.select("id", F.explode("buckets").alias("bucket"))
    heavy = stored(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > crowded), folder, "heavy")
    inside = spread.join(heavy, "bucket")
    chosen = inside.filter(F.pmod(F.xxhash64("id", "bucket"), F.col("size")) < SAMPLE)
    sample = chosen.join(vectors.select("id", "vec"), "id").select("bucket", "size", "vec")
    found = sample.groupBy("bucket").applyInArrow(_densest(cosine), "size long, vec array<double>")
    centres = stored(found.withColumn("id", -1 - F.monotonically_increasing_id()), folder, "centres")
    # A vector goes to the centre of the largest bucket among those that share a bucket with it.
    seats = signatures(centres, k, tables).select("id", F.explode("buckets").alias("bucket")).join(centres.select("id", "size"), "id")
    first = seats.groupBy("bucket").agg(F.max(F.struct("size", "id")).alias("seat"))
    choice = spread.join(first, "bucket").groupBy("id").agg(F.max("seat").alias("seat")).select("id", F.col("seat.id").alias("ball"))
    both = choice.join(vectors.select("id", "vec", "weight", "first"), "id").join(
        centres.select(F.col("id").alias("ball"), F.col("vec").alias("other")), "ball"
    )

    def rows(batch: pa.RecordBatch) -> dict:
        _, angle = _angles(batch)
        return {c: batch.column(c) for c in ("id", "ball", "weight", "first")} | {"angle": angle}

    reach = math.acos(cosine) / 2 - 1e-6
    near = stored(batches_of(both, rows, "id long, ball long, weight long, first long, angle double", 4 << 20).filter(F.col("angle") <= reach), folder, "near")
    sizes = near.groupBy("ball").agg(
        F.max("angle").alias("r"), F.sum("weight").alias("weight"), F.min("first").alias("first"), F.count(F.lit(1)).alias("members")
    ).filter("members > 1")
    balls = stored(
        sizes.join(centres.select(F.col("id").alias("ball"), "vec"), "ball").select(F.col("ball").alias("id"), "vec", "r", "weight", "first"), folder, "balls"
    )
    return balls, stored(near.join(balls.select(F.col("id").alias("ball")), "ball", "left_semi").select("id", "ball"), folder, "members")


def _candidates(cosine: float):
    """Pairs of a bucket whose signs do not rule out that some of their vectors link."""
    angle = math.acos(cosine)

    def allowed(slack: np.ndarray) -> np.ndarray:
        share = np.minimum((angle + slack) / math.pi, 1)
        return SIGNS * (share + 5 * np.sqrt(share * (1 - share) / SIGNS))

    plain = float(allowed(np.zeros(1))[0])

    def different(low: list[np.ndarray], high: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.stack([np.concatenate(low), np.concatenate(high)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in both], names=["a", "b"])

    def pairs(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key = np.stack([columns["bucket"], columns["lo"], columns["hi"]])
        cuts = np.flatnonzero((np.diff(key) != 0).any(0)) + 1
        low, high, held = [], [], 0
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), key.shape[1]], strict=True):
            if b - a < 2:
                continue
            if held > 1 << 18:
                yield different(low, high)
                low, high, held = [], [], 0
            own = {c: v[a:b] for c, v in columns.items()}
            # Bits of unsigned numbers: of a signed one, those of its size would be counted.
            own |= {c: own[c].view(np.uint64) for c in ("s0", "s1")}
            for at in range(0, b - a, 256):
                part = {c: v[at : at + 256] for c, v in own.items()}
                bits = np.bitwise_count(part["s0"][:, None] ^ own["s0"][None]) + np.bitwise_count(part["s1"][:, None] ^ own["s1"][None])
                slack = part["r"][:, None] + own["r"][None] if own["r"].any() else None
                near = bits <= (plain if slack is None else allowed(slack))
                near &= part["id"][:, None] < own["id"][None]
                if own["lo"][0] != own["hi"][0]:
                    near &= part["block"][:, None] != own["block"][None]
                x, y = np.nonzero(near)
                low.append(part["id"][x])
                high.append(own["id"][y])
                held += len(x)
        if held:
            yield different(low, high)

    names = ("bucket", "lo", "hi", "block", "id", "s0", "s1", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            columns = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in names}
            if not len(columns["id"]):
                continue
            ends = np.stack([columns["bucket"], columns["lo"], columns["hi"]])
            other = np.flatnonzero((ends != ends[:, -1:]).any(0))
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield from pairs({c: v[:last] for c, v in columns.items()})
            rest = {c: v[last:] for c, v in columns.items()}
        if rest is not None:
            yield from pairs(rest)

    return run


def candidates(items: DataFrame, cosine: float, folder: str, together: int = TOGETHER) -> DataFrame:
    """Different pairs (a < b) that share a bucket. ``items`` has bucket, id, s0, s1, r, one row a bucket and item."""
    importable(items.sparkSession)
    large = stored(items.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > together), folder, "large")
    parts = F.ceil(F.col("size") * 2 / together)
    # A large bucket's blocks meet two by two, each pair of blocks in a group of its own.
    split = items.join(large, "bucket", "left").withColumn("n", F.coalesce(parts, F.lit(1)))
    block = split.withColumn("block", F.pmod(F.xxhash64("id"), F.col("n"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = block.select(
        "bucket", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "id", "s0", "s1", "r"
    )
    sorted_rows = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return stored(sorted_rows.mapInArrow(_candidates(cosine), "a long, b long").distinct(), folder, "pairs")


def judged(pairs: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) with ``all`` true if all their vectors link, null if some may; pairs without links are left out."""
    limit = math.acos(cosine)
    left = nodes.select(F.col("id").alias("a"), "vec", F.col("r").alias("ra"))
    right = nodes.select(F.col("id").alias("b"), F.col("vec").alias("other"), F.col("r").alias("rb"))

    def rows(batch: pa.RecordBatch) -> dict:
        dot, angle = _angles(batch)
        slack = batch.column("ra").to_numpy(zero_copy_only=False) + batch.column("rb").to_numpy(zero_copy_only=False)
        single = slack == 0
        every = np.where(single, dot >= cosine, angle + slack <= limit - 1e-6)
        some = np.where(single, dot >= cosine, angle - slack <= limit + 1e-6)
        # 2: all link; 1: some may; 0: none does.
        return {"a": batch.column("a"), "b": batch.column("b"), "found": every.astype(np.int32) + some.astype(np.int32)}

    both = pairs.join(left, "a").join(right, "b")
    return batches_of(both, rows, "a long, b long, found int", 4 << 20).filter("found > 0")


def links(pairs: DataFrame, nodes: DataFrame, members: DataFrame, cosine: float, folder: str) -> DataFrame:
    """Linked pairs of nodes. Balls are taken apart only where their members differ in what they link with."""
    done, open_pairs = [], pairs
    for step in range(3):
        found = stored(judged(open_pairs, nodes, cosine), folder, f"judged-{step}")
        done.append(found.filter("found = 2").select("a", "b"))
        part = found.filter("found = 1")
        # A ball on the left is replaced by its members first, then one on the right.
        ball, other = F.when(F.col("a") < 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("a") < 0, F.col("b")).otherwise(F.col("a"))
        open_pairs = part.select(ball.alias("ball"), other.alias("b")).join(members, "ball").select(F.col("id").alias("a"), "b")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def valid(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_vectors(
    table: DataFrame, cosine: float = COSINE, folder: str | None = None, crowded: int = CROWDED, together: int = TOGETHER
) -> DataFrame:
    """One row per row of ``table`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    folder = folder or shared_folder(table.sparkSession)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.withColumn("valid", valid(F.col("vec")))
    distinct = rows.filter("valid").groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
    # Numbered once, in a written table: the same vector has the same number wherever it is read.
    vectors = stored(distinct.withColumn("id", F.monotonically_increasing_id()), folder, "vectors")
    k, tables = plan_of(vectors.count(), cosine)
    signs = stored(signatures(vectors, k, tables), folder, "signatures")
    balls, members = balls_of(vectors, signs, k, tables, cosine, folder, crowded)

    placed = signs.join(members, "id", "left").select("id", "ball", "s0", "s1", F.explode("buckets").alias("bucket"))
    alone = placed.filter("ball IS NULL").select("bucket", "id", "s0", "s1", F.lit(0.0).alias("r"))
    centre_signs = signatures(balls, k, tables).select("id", "s0", "s1").join(balls.select("id", "r"), "id")
    seats = placed.filter("ball IS NOT NULL").select("bucket", F.col("ball").alias("id")).distinct()
    items = alone.unionByName(seats.join(centre_signs, "id").select("bucket", "id", "s0", "s1", "r"))
    pairs = candidates(items, cosine, folder, together)

    nodes = vectors.select("id", "vec", F.lit(0.0).alias("r")).union(balls.select("id", "vec", "r"))
    weights = stored(vectors.select("id", "weight").union(balls.select("id", "weight")), folder, "weights")
    linked = stored(links(pairs, nodes, members, cosine, folder), folder, "links")
    ends = linked.union(linked.select("b", "a")).toDF("id", "to")
    gained = stored(ends.join(weights.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.sum("weight").alias("gain")), folder, "gained")

    # Components of balls and single vectors; a member stands for its ball.
    item = lambda df, c: df.join(members.select(F.col("id").alias(c), F.col("ball").alias(f"{c}_ball")), c, "left").withColumn(c, F.coalesce(f"{c}_ball", c)).drop(f"{c}_ball")
    edges = stored(item(item(linked, "a"), "b").filter("a <> b").distinct(), folder, "edges")
    roots = components(edges, folder)
    roots = stored(roots.union(roots.select("root", "root").distinct()).toDF("id", "root"), folder, "roots")
    whole = (
        vectors.select("id", "weight", "first").join(members, "id", "left")
        .join(gained, "id", "left").withColumnRenamed("gain", "own_gain")
        .join(gained.select(F.col("id").alias("ball"), F.col("gain").alias("ball_gain")), "ball", "left")
        .join(balls.select(F.col("id").alias("ball"), F.col("weight").alias("ball_weight"), F.col("first").alias("ball_first")), "ball", "left")
        .withColumn("item", F.coalesce("ball", "id"))
        .join(roots.select(F.col("id").alias("item"), "root"), "item", "left")
        .withColumn("root", F.coalesce("root", "item"))
    )
    counted = stored(
        whole.select(
            "id", "root", "first",
            (F.coalesce("ball_weight", "weight") - 1 + F.coalesce("own_gain", F.lit(0)) + F.coalesce("ball_gain", F.lit(0))).alias("n_links"),
        ), folder, "counted",
    )
    named = counted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = counted.join(named, "root").join(vectors.select("id", "vec"), "id").select("vec", "n_links", "component_id")
    good = rows.filter("valid").join(known, "vec").select("vec_id", "n_links", "component_id")
    bad = rows.filter("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_stable_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
