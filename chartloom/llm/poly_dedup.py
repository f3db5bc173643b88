"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks. A chunk's hash is a polynomial over its 16-bit
digits, one for each base, modulo a 31-bit prime. Hashes compose: the hash of
``A + B`` is ``hash(A) * base ** digits(B) + hash(B)``, so chunks are hashed on
their own and joined by length-shifted arithmetic. The chunks of a huge text are
rows of their own, hashed by many tasks; its hash is the modular sum of the chunk
hashes, each shifted by the digits to its right. Texts of equal fingerprint
and length are then compared chunk by chunk, and a group with differing chunks
is told apart by SHA-256 of the whole text.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null doc_id is lower than any other; rows that share text and doc_id
are copies of which one stays; an empty table gives an empty result; further
columns are ignored by ``exact_groups`` and kept by ``drop_copies``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import batches_of, shared_folder, stored, texts_of

PRIME = (1 << 31) - 1
BASES = (1103515245, 1664525, 69069, 214013)
#: Bytes of a chunk. 2**15 products of a digit and a power stay below 2**62.
CHUNK = 1 << 16
#: A text of more bytes is hashed and compared chunk by chunk in many tasks.
HUGE = 16 * CHUNK
#: Bits of the map that says which texts may have a copy: 1 MB at any input size.
MAP_BITS = 1 << 23
KEY = ["h1", "h2", "n_bytes"]


def powers(bases: tuple[int, ...] = BASES, prime: int = PRIME, count: int = CHUNK // 2) -> np.ndarray:
    """Row k holds every base to the power k."""
    table = np.ones((count + 1, len(bases)), np.uint64)
    for k in range(1, count + 1):
        table[k] = table[k - 1] * np.array(bases, np.uint64) % np.uint64(prime)
    return table


def chunk_hash(data: bytes, table: np.ndarray, prime: int = PRIME) -> tuple[tuple[int, ...], int]:
    """Hashes and number of digits of one chunk. Only the last chunk of a text may have an odd length."""
    digits = np.frombuffer(data if len(data) % 2 == 0 else data + b"\0", np.uint16).astype(np.uint64)
    size = len(digits)
    return tuple(int(x) % prime for x in digits @ table[:size][::-1]), size


def compose(left: tuple[int, ...], right: tuple[int, ...], shift: np.ndarray, prime: int = PRIME) -> tuple[int, ...]:
    """Hash of two neighbouring stretches; ``shift`` is every base to the digits of the right one."""
    return tuple((a * int(s) + b) % prime for a, b, s in zip(left, right, shift, strict=True))


def fingerprint(data: bytes, table: np.ndarray, prime: int = PRIME) -> tuple[int, ...]:
    whole: tuple[int, ...] = (0,) * table.shape[1]
    for start in range(0, len(data), CHUNK):
        part, size = chunk_hash(data[start : start + CHUNK], table, prime)
        whole = compose(whole, part, table[size], prime)
    return whole


def _digests(prime: int):
    state: dict[str, np.ndarray] = {}

    def rows(batch: pa.RecordBatch) -> dict:
        table = state.get("table")
        if table is None:
            table = state["table"] = powers(prime=prime)
        texts = [x.encode() for x in batch.column("text").to_pylist()]
        prints = [fingerprint(x, table, prime) for x in texts]
        return {
            "doc_id": batch.column("doc_id"),
            "mark": batch.column("mark"),
            "h1": [p[0] << 31 | p[1] for p in prints],
            "h2": [p[2] << 31 | p[3] for p in prints],
            "n_bytes": [len(x) for x in texts],
            "text_sha256": [hashlib.sha256(x).hexdigest() for x in texts],
        }

    return rows


def _chunks(prime: int):
    state: dict[str, np.ndarray] = {}

    def rows(batch: pa.RecordBatch) -> dict:
        table = state.get("table")
        if table is None:
            table = state["table"] = powers(prime=prime)
        made: dict[str, list] = {k: [] for k in (*KEY, "chunk", "part")}
        for text in batch.column("text").to_pylist():
            data = text.encode()
            p = fingerprint(data, table, prime)
            for start in range(0, len(data), CHUNK):
                for k, v in zip(made, (p[0] << 31 | p[1], p[2] << 31 | p[3], len(data), start // CHUNK, data[start : start + CHUNK]), strict=True):
                    made[k].append(v)
        return made

    return rows


def _size() -> Column:
    return F.octet_length("text")


def _pieces(texts: DataFrame) -> DataFrame:
    """Chunks of huge texts, once for each different text: text_sha256, n_bytes, chunk and its low and high content.

    Copies are combined before the shuffle, so one that many documents hold does not gather.
    """
    whole = texts.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), _size().cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("data"))
    chunks = F.sequence(F.lit(0), F.floor((F.col("n_bytes") - 1) / CHUNK).cast("int"))
    placed = whole.select("*", F.explode(chunks).alias("chunk"))
    part = F.substring("data", F.col("chunk") * CHUNK + 1, F.lit(CHUNK))
    return placed.select("text_sha256", "n_bytes", "chunk", part.alias("part")).groupBy("text_sha256", "n_bytes", "chunk").agg(
        F.min("part").alias("low"), F.max("part").alias("high"))


def _shifted(prime: int):
    state: dict[str, np.ndarray] = {}

    def rows(batch: pa.RecordBatch) -> dict:
        table = state.get("table")
        if table is None:
            table = state["table"] = powers(prime=prime)
        made: dict[str, list] = {f"s{k}": [] for k in range(len(BASES))}
        for n_bytes, chunk, part in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "chunk", "low")), strict=True):
            right = (max(n_bytes - (chunk + 1) * CHUNK, 0) + 1) // 2  # digits of the text after this chunk
            for k, value in enumerate(chunk_hash(part, table, prime)[0]):
                made[f"s{k}"].append(value * pow(BASES[k], right, prime) % prime)
        return {**made, "text_sha256": batch.column("text_sha256"), "n_bytes": batch.column("n_bytes")}

    return rows


def huge_prints(texts: DataFrame, prime: int = PRIME) -> DataFrame:
    """text_sha256 and fingerprint of every different text of ``texts``, whose chunks are hashed in parallel."""
    sums = batches_of(_pieces(texts), _shifted(prime), "text_sha256 string, n_bytes long, s0 long, s1 long, s2 long, s3 long", 8 << 20)
    whole = sums.groupBy("text_sha256", "n_bytes").agg(*((F.sum(f"s{k}") % prime).alias(f"s{k}") for k in range(len(BASES))))
    joined = lambda a, b: F.shiftleft(a, 31).bitwiseOR(F.col(b))
    return whole.select("text_sha256", joined("s0", "s1").alias("h1"), joined("s2", "s3").alias("h2"), "n_bytes")


def _may_repeat(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``repeats``: whether the mark of a row shares a bit with that of a group.

    The map has MAP_BITS bits, so its broadcast is bounded.
    """
    spot = F.pmod("mark", F.lit(MAP_BITS))
    bits = (
        groups.select(spot.alias("spot"))
        .groupBy(F.bitmap_bucket_number("spot").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    )
    place = F.bitmap_bit_position("spot")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn("spot", spot)
        .withColumn("bucket", F.bitmap_bucket_number("spot"))
        .join(F.broadcast(bits), "bucket", "left")
        .withColumn("repeats", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
        .drop("spot", "bucket", "bits")
    )


def exact_groups(docs: DataFrame, prime: int = PRIME, folder: str | None = None, huge: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    ``prime`` and ``huge`` are lowered only in tests, to force fingerprints to
    collide and texts to be spread.
    """
    return _groups(docs, prime, folder or shared_folder(docs.sparkSession), huge).drop("mark")


def _groups(docs: DataFrame, prime: int, folder: str, huge: int = HUGE) -> DataFrame:
    """The rows of ``exact_groups`` with the mark of their text."""
    texts = texts_of(docs).withColumn("mark", F.xxhash64("text"))
    prints = stored(huge_prints(texts.filter(_size() > huge), prime), folder, "huge")
    shape = "doc_id long, mark long, h1 long, h2 long, n_bytes long, text_sha256 string"
    of_huge = texts.filter(_size() > huge).select("doc_id", "mark", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).join(
        prints, "text_sha256").select("doc_id", "mark", *KEY, "text_sha256")
    narrow = stored(
        batches_of(texts.filter(_size() <= huge), _digests(prime), shape).union(of_huge)
        .withColumn("row", F.monotonically_increasing_id()),
        folder, "digests",
    )

    def grouped(rows: DataFrame, key: list[str], name: str) -> DataFrame:
        return stored(
            rows.groupBy(*key)
            .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("size"),
                 F.min("mark").alias("mark"), F.max("mark").alias("other_mark"))
            .filter("size > 1"),
            folder, name,
        )

    groups, key = grouped(narrow, KEY, "groups"), KEY
    # Texts of one mark share its bit in the map; a group of two marks is unequal without a look.
    # Smallest and largest content of a chunk are equal exactly if all contents are; both are combined before the shuffle.
    again = _may_repeat(texts, groups).filter("repeats").select("text")
    parts = batches_of(again.filter(_size() <= huge), _chunks(prime), "h1 long, h2 long, n_bytes long, chunk int, part binary", 8 << 20)
    long_parts = _pieces(again.filter(_size() > huge)).join(prints, ["text_sha256", "n_bytes"])
    unequal = stored(
        parts.select(*KEY, "chunk", F.col("part").alias("low"), F.col("part").alias("high"))
        .union(long_parts.select(*KEY, "chunk", "low", "high"))
        .groupBy(*KEY, "chunk").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter("low <> high").select(*KEY)
        .union(groups.filter("mark <> other_mark").select(*KEY)).distinct(),
        folder, "unequal",
    )
    if not unequal.isEmpty():
        narrow = narrow.join(unequal.withColumn("apart", F.lit(True)), KEY, "left").withColumn(
            "variant", F.when(F.col("apart"), F.col("text_sha256")).otherwise("")
        ).drop("apart")
        key = [*KEY, "variant"]
        groups = grouped(narrow, key, "variants")
    return narrow.join(groups.drop("mark", "other_mark"), key, "left").select(
        "doc_id", "mark",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        (F.col("size").isNull() | (F.col("row") == F.col("keep.row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Only rows whose text may repeat, by the bits of the marks, are moved; the others go through.
    """
    folder = shared_folder(docs.sparkSession)
    several = stored(_groups(docs, PRIME, folder).filter("group_size > 1").select("doc_id", "text_sha256", "kept", "mark"), folder, "several")
    keys = stored(
        several.groupBy(F.col("doc_id").alias("key_id"), F.col("text_sha256").alias("key_sha"))
        .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows")),
        folder, "keys",
    )
    # The row travels as one column, so that no name of it can clash.
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("id"))
    marked = _may_repeat(rows.withColumn("mark", F.xxhash64("text")), several)
    looked_at = marked.filter("repeats").withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).drop("text", "mark")
    known = looked_at.join(keys, F.col("id").eqNullSafe(F.col("key_id")) & (F.col("sha") == F.col("key_sha")), "left")
    out = marked.filter("NOT repeats").select("row").union(known.filter("stays IS NULL OR (stays AND rows = 1)").select("row"))
    if not keys.filter("rows > 1").isEmpty():
        out = out.union(known.filter("stays AND rows > 1").dropDuplicates(["id", "sha"]).select("row"))
    return out.select("row.*")


def op7_poly_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
