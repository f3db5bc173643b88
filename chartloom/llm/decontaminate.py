"""Benchmark decontamination with a broadcast hash set of test n-grams.

Every window of ten consecutive words of a benchmark item is hashed (an item of
fewer words is one window). The hash set is broadcast when its proven size
allows it and joined by a shuffle otherwise; document windows are scanned
against it inside the scan, hits are verified word by word against the
benchmark's windows, and documents or word spans with hits are removed. Only
DataFrame functions are used.

Defined results: a null text has no words and no hit; an item without words has
no window; documents with the same doc_id and text are one document with equal
results, one row each; a null doc_id is an id like any other; repeated items
count once by item_id; empty tables give no rows or no hits; further columns
are ignored by ``hits`` and kept by ``drop_documents`` and ``cut_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import lower_ascii, shared_folder, stored

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that was not lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Hashes in a broadcast set; with its table of places and rows each takes under 100 bytes, so 100 MB at most.
BROADCAST_HASHES = 1_000_000
#: Stands for the row that every document contributes once.
WHOLE = -1


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def hash_at(words: Column, place: Column, width: int) -> Column:
    """Hash of ``width`` words from ``place`` (0-based); words beyond the end are skipped."""
    return F.xxhash64(*[F.get(words, place + k) for k in range(width)])


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(h, window, n, item_id) of all windows, without repeats."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    size = F.size("words")
    placed = items.select(
        "item_id", "words", F.least(size, F.lit(width)).alias("n"),
        F.explode(F.sequence(F.lit(0), F.greatest(size - width, F.lit(0)))).alias("place"),
    )
    window = placed.select("item_id", "n", F.slice("words", F.col("place") + 1, F.col("n")).alias("window"))
    return window.select(hash_at(F.col("window"), F.lit(0), width).alias("h"), "window", "n", "item_id").distinct()


def _split(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key, n_bytes and words of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.select("*", F.xxhash64("text").alias("text_key"), F.octet_length("text").alias("n_bytes"), words_of(F.col("text")).alias("words"))


def _scan(docs: DataFrame, hashes: DataFrame, widths: list[int], width: int) -> DataFrame:
    """Candidate windows, and one row with place WHOLE for every document."""
    split = _split(docs).drop("text")
    last = F.size("words") - min(widths, default=width)
    places = split.select("*", F.explode(F.sequence(F.lit(WHOLE), F.greatest(last, F.lit(WHOLE)))).alias("place"))
    fits = lambda n: F.col("place") + n <= F.size("words")
    one = [F.struct(F.lit(n).alias("n"), F.when(fits(n), hash_at(F.col("words"), F.col("place"), n)).alias("h")) for n in widths]
    whole = F.struct(F.lit(0).alias("n"), F.lit(WHOLE).cast("long").alias("h"))
    if len(one) == 1:
        tried = places.withColumn("try", F.when(F.col("place") == WHOLE, whole).otherwise(one[0]))
    else:
        tried = places.withColumn("try", F.explode(F.when(F.col("place") == WHOLE, F.array(whole)).otherwise(F.array(*one))))
    spot = tried.select("doc_id", "text_key", "n_bytes", "words", "place", F.col("try.n").alias("n"), F.col("try.h").alias("h"))
    return spot.join(hashes, "h").select(
        "doc_id", "text_key", "n_bytes", "place", "n", "h",
        F.when(F.col("place") == WHOLE, F.size("words")).alias("n_words"),
        F.when(F.col("place") != WHOLE, F.slice("words", F.col("place") + 1, F.col("n"))).alias("window"),
    )


DOC = ["doc_id", "text_key", "n_bytes"]


def _scan_by_shuffle(docs: DataFrame, hashes: DataFrame, widths: list[int], width: int) -> DataFrame:
    """The rows of ``_scan`` for a set of hashes of any size.

    Only numbers are shuffled to meet the hashes: document, place and hash. A sort-merge
    join lets Spark split the partition of a window that very many documents hold. The
    places found, no more than a document has words, then meet its text once for their words.
    """
    split = _split(docs)
    whole = split.select(
        *DOC, F.lit(WHOLE).alias("place"), F.lit(0).alias("n"), F.lit(WHOLE).cast("long").alias("h"), F.size("words").alias("n_words"),
        F.lit(None).cast("array<string>").alias("window"),
    )
    of_width = lambda n: F.transform(
        F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>")),
        lambda place: F.struct(place.alias("place"), F.lit(n).alias("n"), hash_at(F.col("words"), place, n).alias("h")),
    )
    spots = split.select(*DOC, F.inline(F.concat(*[of_width(n) for n in widths])))
    met = spots.join(hashes.hint("merge"), "h", "left_semi")
    per_doc = met.groupBy(*DOC).agg(F.collect_set(F.struct("place", "n", "h")).alias("met"))
    per_doc = per_doc.select(*[F.col(c).alias(f"met_{c}") for c in DOC], "met")
    same = F.col("doc_id").eqNullSafe(F.col("met_doc_id")) & (F.col("text_key") == F.col("met_text_key")) & (F.col("n_bytes") == F.col("met_n_bytes"))
    texts = split.drop("words").join(per_doc, same).select(*DOC, words_of(F.col("text")).alias("words"), "met")
    windows = texts.select(*DOC, "words", F.inline("met")).select(
        *DOC, "place", "n", "h", F.lit(None).cast("int").alias("n_words"), F.slice("words", F.col("place") + 1, F.col("n")).alias("window")
    )
    return whole.unionByName(windows)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, folder: str | None = None, most: int = BROADCAST_HASHES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated, and the hit word spans."""
    folder = folder or shared_folder(docs.sparkSession)
    tests = stored(windows_of(benchmark, width), folder, "windows")
    # The widths are at most ``width`` small numbers.
    widths = sorted(r.n for r in tests.select("n").distinct().collect()) or [width]
    if tests.count() <= most:
        hashes = tests.select("h").union(docs.sparkSession.range(1).select(F.lit(WHOLE).cast("long").alias("h"))).distinct()
        found = _scan(docs, F.broadcast(hashes), widths, width)
    else:
        found = _scan_by_shuffle(docs, tests.select("h"), widths, width)
    found = stored(found, folder, "found")
    known = tests.select("h", "window", F.lit(True).alias("real")).distinct()
    seen = found.join(known, ["h", "window"], "left")
    ends = F.transform(F.array_sort(F.collect_set(F.when(F.col("real"), F.struct("place", "n")))), lambda s: F.struct(s["place"].alias("start"), (s["place"] + s["n"]).alias("stop")))
    merged = F.aggregate(
        "ends",
        F.array().cast("array<struct<start:int,stop:int>>"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["stop"] >= s["start"]),
            F.concat(
                F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(
                    F.try_element_at(done, F.lit(-1))["start"].alias("start"),
                    F.greatest(F.try_element_at(done, F.lit(-1))["stop"], s["stop"]).alias("stop"),
                )),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    per_doc = (
        seen.groupBy(*DOC)
        .agg(ends.alias("ends"), F.max("n_words").alias("n_words"), F.count_if(F.col("place") == WHOLE).alias("copies"))
        .withColumn("spans", merged)
    )
    of_items = (
        found.filter(F.col("place") != WHOLE).select(*DOC, "h", "window").distinct()
        .join(tests.select("h", "window", "item_id"), ["h", "window"])
        .groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc_id").alias("item_doc"), F.col("text_key").alias("item_key"), F.col("n_bytes").alias("item_bytes"), "items")
    )
    same = F.col("doc_id").eqNullSafe(F.col("item_doc")) & (F.col("text_key") == F.col("item_key")) & (F.col("n_bytes") == F.col("item_bytes"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return (
        per_doc.join(of_items, same, "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id", "text_key", "n_bytes", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"),
            F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
            (hit > 0).alias("contaminated"), "spans",
        )
    )


def _marked(docs: DataFrame, benchmark: DataFrame, how: str) -> DataFrame:
    """Documents, each as one column so that no name of it can clash, joined to their hit spans."""
    bad = (
        hits(docs, benchmark).filter("contaminated")
        .select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key"), F.col("n_bytes").alias("bad_bytes"), "spans")
        .dropDuplicates(["bad_id", "bad_key", "bad_bytes"])
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), F.octet_length(text).alias("bytes")
    )
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")) & (F.col("bytes") == F.col("bad_bytes"))
    return marked.join(bad, same, how)


def drop_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    return _marked(docs, benchmark, "left_anti").select("row.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents; the words of hit spans and what stands between them are removed from the text."""
    joined = _marked(docs, benchmark, "left").withColumn("words", F.regexp_extract_all("row.text", F.lit(RAW_WORD), F.lit(0)))
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["stop"]))
    gap_inside = lambda i: F.exists("spans", lambda s: (s["start"] < i) & (i < s["stop"]))
    kept = F.transform(F.split("row.text", RAW_WORD, -1), lambda g, i: F.concat(
        F.when(gap_inside(i), F.lit("")).otherwise(g),
        F.when(inside(i), F.lit("")).otherwise(F.coalesce(F.get("words", i), F.lit(""))),
    ))
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, ""))
    return joined.withColumn("row", F.col("row").withField("text", text)).select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, w[p:p + n - 1] AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, p, n, w[p:p + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT dw.doc_id, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
