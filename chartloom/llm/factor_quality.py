"""Quality classifier: a factorisation machine over words, structure and size.

Features of a text: its different words, hashed, each with weight
``1 / sqrt(number of different words)``; structure statistics (shares of
capitals, digits, marks, repeated words and lines, word lengths), each both as
a standardised value and as one of ``BINS`` bins; and its size in words and
lines, treated alike. Pair interactions have rank ``RANK`` and are scored in
linear time: for every factor, half of (sum of v x) squared minus the sum of
(v x) squared.

The machine is fitted on at most ``TRAIN_ROWS`` labelled documents, those with
the smallest hash of their doc_id, none of them held out (crc32 of the doc_id
as text, modulo 4, is 2). Labels, lang, source and doc_id are no features.

Defined results: a null or empty text is scored like any other, from statistics
of zero; without labels of both kinds the score is the share of label 1, or 0.5
without any; several labels of one document count as their largest; a null
doc_id is not held out and has no label; repeated rows get equal results; an
empty table gives no row; further columns are ignored by ``scores`` and kept by
``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import batches_of, texts_of

WORD_SPACE = 1 << 14
RANK = 6
BINS = 8
TRAIN_ROWS = 6000
EPOCHS = 14
GOOD = 0.7
STATISTICS = (
    "capitals", "digits", "marks", "odd_marks", "stops", "spaces", "line_ends", "beyond_ascii", "word_length", "long_words",
    "short_words", "different_words", "next_repeats", "top_word", "different_lines", "mark_only_words", "capital_words", "words", "lines",
)


#: Features that are scored at once, and characters of the words that a worker remembers.
TOGETHER, REMEMBERED = 100_000, 1 << 20


class Features:
    """Sparse word features and dense statistics of texts."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        self.held = 0

    def words(self, different: set[str]) -> np.ndarray:
        new = different.difference(self.places)
        if new:
            self.held += sum(map(len, new))
            if self.held > REMEMBERED:
                self.places, new, self.held = {}, different, sum(map(len, different))
            self.places.update((w, zlib.crc32(w.encode()) % WORD_SPACE) for w in new)
        return np.fromiter(map(self.places.__getitem__, different), np.int64, len(different))

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words, lines = text.split(), [x for x in text.split("\n") if x]
        statistics = np.zeros(len(STATISTICS))
        if not words:
            return np.zeros(0, np.int64), statistics
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        seen = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size, n = int(seen.sum()), len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        letters = int(seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum())
        marks = size - letters - int(seen[48:58].sum()) - int(seen[9:14].sum() + seen[32])
        usual = int(sum(seen[ord(c)] for c in ".,;:'\"-?()"))
        statistics[:] = (
            seen[65:91].sum() / size, seen[48:58].sum() / size, marks / size, (marks - usual) / size, (seen[46] + seen[63] + seen[33]) / n,
            seen[32] / size, seen[10] / size, seen[128:].sum() / size, lengths.mean(), (lengths > 15).mean(), (lengths < 3).mean(),
            len(counts) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, max(counts.values()) / n,
            len(set(lines)) / max(1, len(lines)), sum(c for w, c in counts.items() if not any(map(str.isalnum, w))) / n,
            sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n, np.log1p(n), np.log1p(len(lines)),
        )
        return self.words(set(counts)), statistics


class Machine:
    """Bias, weights, factors, and how statistics become features."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, mean: np.ndarray, scale: np.ndarray, edges: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors
        self.mean, self.scale, self.edges = mean, scale, edges

    def rows(self, made: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of texts as places, values and row starts."""
        n = len(STATISTICS)
        stats = np.array([s for _, s in made]).reshape(-1, n)
        bins = WORD_SPACE + np.arange(n) * (BINS + 1) + (stats[:, :, None] > self.edges[None]).sum(2)
        dense = WORD_SPACE + n * (BINS + 1) + np.arange(n)
        values = np.clip((stats - self.mean) / self.scale, -4, 4)
        places, amounts, starts = [], [], [0]
        for (words, _), own_bins, own in zip(made, bins, values, strict=True):
            places += [words, own_bins, dense]
            amounts += [np.full(len(words), 1 / np.sqrt(max(1, len(words)))), np.full(n, 0.5), own * 0.5]
            starts.append(starts[-1] + len(words) + 2 * n)
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return flat(places, np.int64), flat(amounts, np.float64), np.array(starts)

    def logits(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if len(starts) == 1:
            return np.zeros(0)
        seen = self.factors[places]
        seen *= values[:, None]
        sums = np.add.reduceat(seen, starts[:-1], axis=0)
        seen *= seen
        squares = np.add.reduceat(seen, starts[:-1], axis=0)
        linear = np.add.reduceat(self.weights[places] * values, starts[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(1)


def fit(made: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Fit by Adam on the logistic loss."""
    n = len(STATISTICS)
    space = WORD_SPACE + n * (BINS + 2)
    share = float(labels.mean()) if len(labels) else 0.5
    flat = Machine(0.0, np.zeros(space), np.zeros((space, RANK)), np.zeros(n), np.ones(n), np.zeros((n, BINS)))
    if share in (0.0, 1.0) or not len(labels):
        flat.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return flat
    stats = np.array([s for _, s in made])
    edges = np.quantile(stats, np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    rng = np.random.default_rng(seed)
    machine = Machine(
        float(np.log(share / (1 - share))), np.zeros(space), rng.normal(0, 0.02, (space, RANK)), stats.mean(0), stats.std(0) + 1e-9, edges
    )
    weights = np.concatenate([machine.weights[:, None], machine.factors], axis=1)
    moment, spread, step = np.zeros_like(weights), np.zeros_like(weights), 0
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        for begin in range(0, len(order), 128):
            chosen = order[begin : begin + 128]
            places, values, starts = machine.rows([made[i] for i in chosen])
            machine.weights, machine.factors = weights[:, 0], weights[:, 1:]
            error = 1 / (1 + np.exp(-machine.logits(places, values, starts))) - labels[chosen]
            each = np.repeat(error / len(chosen), np.diff(starts))
            sums = np.add.reduceat(machine.factors[places] * values[:, None], starts[:-1], axis=0)
            inner = np.repeat(sums, np.diff(starts), axis=0)
            slope = np.zeros_like(weights)
            slope[:, 0] = np.bincount(places, each * values, space)
            for f in range(RANK):
                slope[:, f + 1] = np.bincount(places, each * values * (inner[:, f] - machine.factors[places, f] * values), space)
            slope += 1e-4 / len(order) * weights
            step += 1
            rate = 0.02 / (1 + 0.2 * epoch)
            machine.bias -= rate * float(error.mean())
            moment = 0.9 * moment + 0.1 * slope
            spread = 0.999 * spread + 0.001 * slope * slope
            weights = weights - rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    machine.weights, machine.factors = np.ascontiguousarray(weights[:, 0]), np.ascontiguousarray(weights[:, 1:])
    return machine


def score_texts(features: Features, machine: Machine, texts: Iterable[str | None]) -> np.ndarray:
    """Scores of texts. What is held follows the number of features, so texts are scored when they have TOGETHER of them."""
    made, size, out = [], 0, []

    def flush() -> None:
        out.append(1 / (1 + np.exp(-np.clip(machine.logits(*machine.rows(made)), -35, 35))))
        made.clear()

    for text in texts:
        places, statistics = features.of(text or "")
        made.append((np.sort(places), statistics))
        size += len(places) + 2 * len(STATISTICS)
        if size >= TOGETHER:
            flush()
            size = 0
    if made:
        flush()
    return np.concatenate(out) if out else np.zeros(0)


def each(column: pa.Array) -> Iterator[str | None]:
    """Values of a column, a few at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``rows`` labelled documents. Their features, not their texts, reach the driver."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # At most ``rows`` pairs of numbers are broadcast.
    texts = texts_of(docs).join(F.broadcast(known), "doc_id")

    def features(batch: pa.RecordBatch) -> dict:
        own = Features()
        made = [own.of(t) for t in each(batch.column("text"))]
        return {
            "doc_id": batch.column("doc_id"), "quality": batch.column("quality"),
            "places": pa.array([p for p, _ in made], pa.list_(pa.int32())), "statistics": pa.array([s for _, s in made], pa.list_(pa.float64())),
        }

    made = batches_of(texts, features, "doc_id long, quality int, places array<int>, statistics array<double>", 4 << 20)
    # One row for a doc_id, however often it is repeated, so that at most ``rows`` rows reach the driver.
    one = made.groupBy("doc_id").agg(F.min(F.struct("statistics", "places", "quality")).alias("row")).select("doc_id", "row.*")
    taken = sorted(one.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    made = [(np.sort(np.array(r["places"], np.int64)), np.array(r["statistics"])) for r in taken]
    return fit(made, np.array([r["quality"] for r in taken], np.float64))


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is fixed by WORD_SPACE and RANK
    state: dict[str, Features] = {}

    def rows(batch: pa.RecordBatch) -> dict:
        features = state.setdefault("features", Features())
        return {"doc_id": batch.column("doc_id"), "score": score_texts(features, shared.value, each(batch.column("text")))}

    scored = batches_of(texts_of(docs), rows, "doc_id long, score double", 4 << 20)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, machine: Machine) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    good = GOOD

    def run(batches):
        features = Features()
        for batch in batches:
            yield batch.filter(pa.array(score_texts(features, shared.value, each(batch.column("text"))) >= good))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)


def op8_factor_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
