import random
import zlib

import numpy as np
import pytest

from chartloom.llm import factor_quality as op


def text(rng, good):
    words = [rng.choice(["river", "stone", "went", "over", "the", "old", "hill", "bright"]) + str(rng.randrange(20)) for _ in range(rng.randrange(8, 120))]
    if good:
        return " ".join(words) + "."
    return rng.choice([" ".join(w.upper() + "!!" for w in words), " ".join(w + "$$$" for w in words), " ".join([words[0]] * 60)])


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    labels = [(k, int(rng.random() < 0.8), 0) for k in range(600)]
    docs = [(k, text(rng, good)) for k, good, _ in labels]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: good for k, good, _ in labels}


def test_pairs_in_linear_time():
    rng = np.random.default_rng(1)
    made = [op.Features().of(t) for t in ("a b c d", "x", "")]
    n = len(op.STATISTICS)
    space = op.WORD_SPACE + n * (op.BINS + 2)
    machine = op.Machine(0.3, rng.normal(size=space), rng.normal(size=(space, op.RANK)), np.zeros(n), np.ones(n), np.zeros((n, op.BINS)))
    places, values, starts = machine.rows(made)
    for k, got in enumerate(machine.logits(places, values, starts)):
        p, x = places[starts[k] : starts[k + 1]], values[starts[k] : starts[k + 1]]
        pairs = sum(machine.factors[p[i]] @ machine.factors[p[j]] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert np.isclose(got, 0.3 + machine.weights[p] @ x + pairs)


def test_held_out_accuracy_and_odd_rows(documents, case):
    docs, labels, good = case
    rows = docs + [(9001, None), (9002, ""), (None, "some words"), docs[0], (9003, "word " * 50_000)]
    frame = documents(rows)
    got = op.scores(frame, op.train(frame, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in good]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out) and len(out) > 100
    assert np.mean([r.predicted == good[r.doc_id] for r in out]) > 0.95
    assert len({r.score for r in got if r.doc_id == docs[0][0]}) == 1
    by = {r.doc_id: r for r in got}
    assert by[9001].score == by[9002].score and by[None].held_out is False


def test_held_out_labels_are_not_used(spark, documents, case):
    docs, labels, _ = case
    frame = documents(docs)
    flipped = labels.withColumn("quality", op.F.when(op.held_out(op.F.col("doc_id")), 1 - op.F.col("quality")).otherwise(op.F.col("quality")))
    one, two = op.train(frame, labels), op.train(frame, flipped)
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_few_labels_and_rejection(spark, documents, case):
    docs, labels, good = case
    frame = documents(docs)
    none = op.train(frame, labels.limit(0))
    assert {round(r.score, 6) for r in op.scores(frame, none).collect()} == {0.5}
    assert op.scores(documents([]), none).count() == 0
    machine = op.train(frame, labels)
    kept = op.keep_good(frame, machine)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == frame.columns
    assert ids == {r.doc_id for r in op.scores(frame, machine).collect() if r.predicted}


def test_scores_do_not_depend_on_how_many_are_made_at_once(monkeypatch):
    rng = random.Random(8)
    texts = [text(rng, k % 2) for k in range(60)] + ["", None]
    made = [op.Features().of(t or "") for t in texts]
    machine = op.fit(made, np.array([k % 2 for k in range(62)], float), epochs=2)
    together = op.score_texts(op.Features(), machine, texts)
    monkeypatch.setattr(op, "TOGETHER", 100)
    monkeypatch.setattr(op, "REMEMBERED", 50)
    assert np.allclose(op.score_texts(op.Features(), machine, texts), together) and len(together) == 62
    assert len(op.score_texts(op.Features(), machine, [])) == 0
