"""Substring deduplication with sliding sentence spans.

Words are what ASCII white space parts. A sentence ends after a word with a
stop, and at a line end. A sentence of more than ``LONG`` words is cut further
after words whose hash is a multiple of ``EVERY``, so that a passage has the
same inner cuts wherever it stands, also in texts without stops. At every
sentence a span starts: the shortest run of at least ``SENTENCES`` consecutive
sentences with at least ``WORDS`` words. Spans are hashed and joined over all
documents; the first occurrence of a span, by doc_id and then by place, stays,
and every sentence covered by any other occurrence is removed.

Cuts inside a passage need a few words to fall in step, so a passage of over
50 words of prose holds a whole span; shorter repeats, such as single lines,
stay.

Defined results: a null text counts as empty and stays null in ``cut``; rows
with the same doc_id and text are one occurrence and get equal results; of
equal texts with different doc_ids, the lowest stays whole; a null doc_id comes
before all others; an empty table gives no row; further columns are ignored by
``repeats`` and kept by ``cut``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import batches_of, shared_folder, stored, texts_of

SENTENCES = 2
WORDS = 25
LONG = 12
EVERY = 4
#: Odd bases of the two span hashes (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Stands for a line end between words.
LINE_END = "\x1e"
WORD = re.compile(r"[^ \t\n\x0b\x0c\r\x1e]+|[\n\x1e]")


def sentences_of(stop: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether a sentence ends after each word; ``stop`` says where it must, ``cut`` where a long one may."""
    number = np.concatenate([[0], np.cumsum(stop)[:-1]]).astype(np.int64) if len(stop) else np.zeros(0, np.int64)
    long = np.bincount(number)[number] > LONG if len(number) else np.zeros(0, bool)
    return stop | (long & cut)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def sentence_ranges(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences of one text."""
    words, stops, ranges = [], [], []
    for m in WORD.finditer(text):
        if m.group() in ("\n", LINE_END):
            if stops:
                stops[-1] = True
        else:
            words.append(m.group())
            stops.append(m.group()[-1] in ".!?")
            ranges.append(m.span())
    if not words:
        return []
    stops[-1] = True
    ends = np.flatnonzero(sentences_of(np.array(stops), word_hashes(words) % EVERY == 0)).tolist()
    return [(ranges[a][0], ranges[b][1]) for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends, strict=True)]


def stretch_hashes(words: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of stretches of words by differences of prefix sums, modulo 2**64, then mixed with their length."""
    with np.errstate(over="ignore"):
        up, down = np.full(len(words), base, np.uint64), np.full(len(words), pow(base, -1, 1 << 64), np.uint64)
        up[:1] = down[:1] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
        mixed = (total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed


def spans_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the spans of many texts: text, two hashes, and place (sentence and number of sentences)."""
    listed = pc.ascii_split_whitespace(pc.replace_substring(texts, "\n", f" {LINE_END} "))
    sizes = pc.list_value_length(listed).to_numpy()
    coded = pc.dictionary_encode(pc.list_flatten(listed))
    names = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashes = word_hashes(names)
    kind = np.array([0 if not w else 3 if w == LINE_END else 2 if w[-1] in ".!?" else 1 for w in names] or [0], np.int8)[code] if len(code) else np.zeros(0, np.int8)
    lines = np.cumsum(kind == 3)
    real = (kind == 1) | (kind == 2)
    code, owner, lines, kind = code[real], owner[real], lines[real], kind[real]
    none = np.zeros(0, np.int64)
    if not len(code):
        return none, none, none, none
    changes = np.append((lines[1:] != lines[:-1]) | (owner[1:] != owner[:-1]), True)
    word = hashes[code]
    last = np.flatnonzero(sentences_of((kind == 2) | changes, word % EVERY == 0))
    start = np.concatenate([[0], last[:-1] + 1])
    stop = last + 1
    who = owner[start]
    n = len(start)
    limit = np.searchsorted(who, who, side="right")  # the sentence after the last one of the text
    end = np.maximum(np.searchsorted(stop, start + WORDS), np.arange(n) + SENTENCES - 1)  # last sentence of the span
    at = np.flatnonzero(end < limit)
    first = np.searchsorted(who, who[at])
    one, two = (stretch_hashes(word, start[at], stop[end[at]], b).view(np.int64) for b in BASES)
    return who[at], one, two >> 32, (at - first) << 32 | (end[at] - at + 1)


def _span_rows(batch: pa.RecordBatch) -> dict:
    source, span, check, place = spans_of(batch.column("text"))
    take = pa.array(source)
    return {"doc_id": batch.column("doc_id").take(take), "text_key": batch.column("text_key").take(take), "span": span, "check": check, "place": place}


def spans(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, text_key, the hash and its place (sentence and number of sentences)."""
    texts = texts_of(docs).withColumn("text_key", F.xxhash64("text"))
    return batches_of(texts, _span_rows, "doc_id long, text_key long, span long, check long, place long", 8 << 20)


def _removals(texts: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {"n_removed": [], "text": [], "removed": []}
        for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
            if not places:
                for column, value in zip(made.values(), (0, text, []), strict=True):
                    column.append(value)
                continue
            ranges = sentence_ranges(text)
            steps = np.zeros(len(ranges) + 1, np.int64)
            for p in places:
                steps[p >> 32] += 1
                steps[(p >> 32) + (p & 0xFFFFFFFF)] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            kept, cut, at = [], [], 0
            for (start, stop), out in zip(ranges, gone.tolist(), strict=True):
                if out:
                    kept.append(text[at:start])
                    cut.append({"start": start, "stop": stop})
                    at = stop
            kept.append(text[at:])
            made["n_removed"].append(len(cut))
            made["text"].append("".join(kept) if cut else text)
            made["removed"].append(cut)
        return {**made, "doc_id": batch.column("doc_id"), "text_key": batch.column("text_key")}

    return batches_of(
        texts, rows, "doc_id long, text_key long, n_removed long, text string, removed array<struct<start:int,stop:int>>", 4 << 20
    )


def repeats(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, text_key, n_removed, the text that stays, and the removed ranges."""
    folder = folder or shared_folder(docs.sparkSession)
    found = spans(docs)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_key", "place")
    # Only spans seen more than once go on; they are combined before the shuffle.
    firsts = stored(
        found.groupBy("span", "check").agg(F.min(order).alias("low"), F.max(order).alias("high"))
        .filter("low <> high").select("span", "check", F.col("low").alias("first")),
        folder, "firsts",
    )
    later = (
        found.join(firsts, ["span", "check"])
        .filter(~order.eqNullSafe(F.col("first")))
        .groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
    )
    later = stored(later, folder, "later").select(F.col("doc_id").alias("later_id"), F.col("text_key").alias("later_key"), "places")
    texts = texts_of(docs).withColumn("text_key", F.xxhash64("text"))
    same = texts["doc_id"].eqNullSafe(later["later_id"]) & (texts["text_key"] == later["later_key"])
    return _removals(texts.join(later, same, "left").select("doc_id", "text_key", "text", "places"))


def cut(docs: DataFrame) -> DataFrame:
    """All documents and columns, with repeated spans removed from the text."""
    shorter = repeats(docs).filter("n_removed > 0").dropDuplicates(["doc_id", "text_key"]).select(
        F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), F.col("text").alias("cut_text")
    )
    # The row travels as one column, so that no name of it can clash.
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"))
    same = F.col("id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key"))
    joined = marked.join(shorter, same, "left")
    return joined.withColumn("row", F.col("row").withField("text", F.coalesce("cut_text", "row.text"))).select("row.*")


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), "text", "removed"
    )
