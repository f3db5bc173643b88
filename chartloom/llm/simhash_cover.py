"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of a covering code on the 64 fingerprint bits: the
product of two binary Golay codes (23 bits each, covering radius 3) and of all
18-bit words (radius 0) would be one; only the two Golay parts name an anchor
here, so an anchor stands for all values of the other 18 bits. Every
fingerprint has one home anchor. A fingerprint within two bits of it differs by
``a`` bits in the first part and ``b`` in the second, ``a + b <= 2``, so it lies
within ``3 + a`` and ``3 + b`` of that home. Fingerprints are replicated to all
such anchors (about 60) and compared per anchor.

Only different fingerprints are replicated, and links are kept as a forest:
within an anchor every fingerprint is linked to the smallest of its part, never
to all partners. Anchors with more than ``DIRECT`` members are compared by
midpoints: two fingerprints link exactly if they share a value within one bit
of both, so grouping by such values finds all links by a partial aggregation
of any group size. Components come from repeated smallest-neighbour steps
on those edges, each written to the shared folder.

Defined results: a null or empty text has fingerprint zero and links like any
other; texts of one or two words use the whole sequence; equal texts share a
fingerprint; repeated rows give repeated results; a null doc_id takes part and
is the smallest of a component only if no other id is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import batches_of, shared_folder, stored, texts_of

SEED = 42
SHINGLE = 3
THRESHOLD = 2
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
#: Members of an anchor that are compared pair by pair in one task.
DIRECT = 512
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(data: bytes) -> int:
    """Fingerprint of a UTF-8 text."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    width = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops[width - 1 :], strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def _fingerprint_rows(batch: pa.RecordBatch) -> dict:
    prints = np.array([simhash(x.encode()) for x in batch.column("text").to_pylist()], np.uint64)
    return {"doc_id": batch.column("doc_id"), "bits": prints.view(np.int64)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the 64 bits as a signed long."""
    return batches_of(texts_of(docs), _fingerprint_rows, "doc_id long, bits long")


@cache
def golay() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Syndrome to leader, all syndromes of 23-bit words, and for a leader the code words by extra distance.

    ``around[leader index][extra]`` holds code words ``w`` for which
    ``weight(leader ^ w)`` is at most 3 for extra 0 and exactly ``3 + extra`` above.
    """
    words = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        code ^= np.where(words >> bit & 1, GOLAY << bit, 0)
    light = [0, *(1 << i for i in range(23))]
    light += [1 << i | 1 << j for i in range(23) for j in range(i)]
    light += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    leaders = np.zeros(1 << 11, np.int64)
    leaders[syndrome(np.array(light, np.int64))] = light
    around = []
    for leader in leaders.tolist():
        weight = np.bitwise_count(code ^ leader)
        around.append([code[weight <= 3], code[weight == 4], code[weight == 5]])
    return leaders, code, around


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


def anchors_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: source index, anchor, and whether it is the home anchor."""
    leaders, _, around = golay()
    part = [(bits >> np.uint64(shift) & np.uint64((1 << 23) - 1)).astype(np.int64) for shift in (0, 23)]
    synd = [syndrome(p) for p in part]
    home = [p ^ leaders[s] for p, s in zip(part, synd, strict=True)]
    source, anchor, at_home = [], [], []
    for i, (s, t, c, d) in enumerate(zip(synd[0].tolist(), synd[1].tolist(), home[0].tolist(), home[1].tolist(), strict=True)):
        a, b = around[s], around[t]
        made = [
            ((a[x] ^ c)[:, None] << 23 | (b[y] ^ d)[None, :]).ravel()
            for x in range(THRESHOLD + 1) for y in range(THRESHOLD + 1 - x)
        ]
        own = np.concatenate(made)
        source.append(np.full(len(own), i))
        anchor.append(own)
        at_home.append(own == (c << 23 | d))
    if not source:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(source), np.concatenate(anchor), np.concatenate(at_home)


def _replicas(batch: pa.RecordBatch) -> dict:
    bits = batch.column("bits").to_numpy(zero_copy_only=False)
    source, anchor, home = anchors_of(bits.view(np.uint64))
    return {"anchor": anchor, "bits": bits[source], "home": home}


def _homes(batch: pa.RecordBatch) -> dict:
    leaders, _, _ = golay()
    bits = batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
    part = [(bits >> np.uint64(shift) & np.uint64((1 << 23) - 1)).astype(np.int64) for shift in (0, 23)]
    home = [p ^ leaders[syndrome(p)] for p in part]
    return {"anchor": home[0] << 23 | home[1]}


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of sorted anchors. An anchor is held whole; larger ones than DIRECT do not come here."""
    rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def edges(anchor: np.ndarray, bits: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        low, high = [], []
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(anchor)], strict=True):
            if stop - start < 2 or not home[start:stop].any():
                continue
            own = bits[start:stop]
            seats = own[home[start:stop]]
            near = np.bitwise_count(seats[:, None] ^ own[None, :]) <= THRESHOLD
            a, b = np.nonzero(near)
            a, b = seats[a], own[b]
            keep = a != b
            a, b = a[keep], b[keep]
            if len(a):
                x, y = forest(a, b)
                low.append(x)
                high.append(y)
        pair = [np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (low, high)]
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in pair], names=["a", "b"])

    for batch in batches:
        new = (
            batch.column("anchor").to_numpy(zero_copy_only=False),
            batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64),
            batch.column("home").to_numpy(zero_copy_only=False),
        )
        all_of = new if rest is None else tuple(np.concatenate(v) for v in zip(rest, new, strict=True))
        last = int(np.searchsorted(all_of[0], all_of[0][-1])) if len(all_of[0]) else 0
        if last:
            yield edges(*(v[:last] for v in all_of))
        rest = tuple(v[last:] for v in all_of)
    if rest is not None and len(rest[0]):
        yield edges(*rest)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the links to the smallest of its component, at most one a node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _midpoints(batch: pa.RecordBatch) -> dict:
    bits = batch.column("bits").to_numpy(zero_copy_only=False)
    flips = np.array([0, *(1 << i for i in range(64))], np.uint64).view(np.int64)
    return {"point": (bits[:, None] ^ flips[None, :]).ravel(), "bits": np.repeat(bits, 65)}


def grown(df: DataFrame) -> DataFrame:
    """Rows that Spark sizes like their source, though they are many times as many: they are never broadcast."""
    return df.hint("merge")


def meet(distinct: DataFrame, homes: DataFrame) -> DataFrame:
    """Replicas of the fingerprints at anchors that are someone's home; the join drops the other replicas."""
    replicas = batches_of(distinct.select("bits"), _replicas, "anchor long, bits long, home boolean", 1 << 16)
    return grown(replicas).join(homes, "anchor")


def midpoints(busy: DataFrame) -> DataFrame:
    """Values within one bit of the fingerprints."""
    return batches_of(busy, _midpoints, "point long, bits long", 1 << 18)


def links(distinct: DataFrame, folder: str, direct: int = DIRECT) -> DataFrame:
    """Edges (a, b) between different fingerprints whose components are those of all links."""
    homes = stored(batches_of(distinct.select("bits"), _homes, "anchor long").distinct(), folder, "homes")
    met = stored(meet(distinct, homes), folder, "met")
    counts = stored(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), folder, "anchors")
    few = met.join(counts.filter(F.col("size") <= direct).select("anchor"), "anchor")
    small = few.select("anchor", "bits", "home").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long")
    crowded = counts.filter(F.col("size") > direct).select("anchor")
    busy = met.join(crowded, "anchor").select("bits").distinct()
    points = midpoints(busy)
    low = points.groupBy("point").agg(F.min("bits").alias("a"), F.max("bits").alias("high")).filter("a <> high")
    large = grown(points).join(stored(low.select("point", "a"), folder, "points"), "point").filter("a <> bits").select("a", F.col("bits").alias("b"))
    return stored(small.union(large).distinct(), folder, "edges")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node and root (smallest node of its component) for every node of the edges.

    Each round links every node to the smallest of its neighbours and then
    shortens the paths; edges shrink towards stars. Counts alone reach the driver.
    """
    both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("low"))
    seen = None
    for step in range(60):
        # Large star: neighbours above a node move to its smallest neighbour.
        sides = both.union(both.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = stored(
            sides.groupBy("node").agg(F.least(F.min("low"), F.col("node")).alias("least")), folder, f"least-{step}"
        )
        big = (
            sides.join(least, "node").filter(F.col("low") > F.col("node"))
            .select(F.col("low").alias("node"), F.col("least").alias("low"))
        )
        large = stored(big.distinct(), folder, f"large-{step}")
        # Small star: a node and all its lower neighbours move to the smallest of them.
        lows = stored(large.groupBy("node").agg(F.min("low").alias("least")), folder, f"low-{step}")
        new = (
            large.join(lows, "node").select(F.col("low").alias("node"), F.col("least").alias("low"))
            .union(lows.select("node", F.col("least").alias("low"))).filter("node <> low").distinct()
        )
        new = stored(new, folder, f"round-{step}")
        both, before = new, seen
        seen = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return both.select("node", F.col("low").alias("root"))


def near_groups(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id and group_size."""
    folder = folder or shared_folder(docs.sparkSession)
    prints = stored(fingerprints(docs), folder, "prints")
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), folder, "distinct")
    edges = links(distinct, folder)
    roots = components(edges, folder)
    roots = roots.union(roots.select("root", "root").distinct()).toDF("bits", "root")
    members = stored(roots.join(distinct, "bits"), folder, "members")
    named = members.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("group_size"))
    linked = members.select("bits", "root").join(named, "root").select("bits", "component_id", "group_size")
    alone = distinct.join(linked.select("bits"), "bits", "left_anti").select("bits", F.col("first").alias("component_id"), F.col("rows").alias("group_size"))
    classes = stored(linked.union(alone), folder, "classes")
    return prints.join(classes, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "group_size"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group: that with the smallest doc_id. All columns are kept."""
    groups = near_groups(docs)
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_kept_id"]), "left_semi")


def op3_simhash_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("group_size")
