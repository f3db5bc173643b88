import random
import re

import pytest
from pyspark.sql import functions as F

from chartloom.llm import secret_forest as op
from chartloom.llm.shared import shared_folder


def prose(rng, n):
    return " ".join(rng.choice(["the", "river", "stone", "ation", "went", "over", "international", "misunderstanding", "hill", "bright"]) for _ in range(n))


def case(rng, k):
    kind = k % 4
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    if kind == 0:
        return prose(rng, 20) + f' token = "{secret}" ' + prose(rng, 5), True
    if kind == 1:
        return prose(rng, 10) + f" password={secret[:20]} " + prose(rng, 5), True
    if kind == 2:
        return prose(rng, 10) + " internationalmisunderstandingstone " + prose(rng, 5), False
    return prose(rng, 10) + " " + "".join(rng.choice("0123456789") for _ in range(16)) + " " + prose(rng, 4), False


@pytest.fixture(scope="module")
def result(spark):
    rng = random.Random(4)
    made = [case(rng, k) for k in range(400)]
    rows = [(k, t, "repo/a.py") for k, (t, _) in enumerate(made)]
    rows += [(500, None, None), (501, "", "x"), (502, "short words only", "x"), (0, made[0][0], "repo/a.py"), (503, "x" * 100_000 + " é " + "y" * 16, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return rows, made, op.scan(docs.withColumn("label", F.lit(3)).withColumn("value", F.lit("v"))).collect()


def test_places_match_a_plain_search(result):
    rows, _, got = result
    want = [(i, m.start(), m.group()) for i, t, _ in rows for m in re.finditer(op.CANDIDATE, t or "")]
    assert sorted((r.doc_id, r.start, r.value) for r in got) == sorted(want)


def test_false_positives_are_removed(result):
    rows, made, got = result
    wrong = [r for r in got if r.doc_id < 400 and r.value != "misunderstanding" and r.is_secret != made[r.doc_id][1]]
    assert len(wrong) <= 4
    assert not any(r.is_secret for r in got if r.value == "misunderstanding")


def test_features_by_hand(spark):
    folder = shared_folder(spark)
    found = spark.createDataFrame([(1, 1, "src/test/a", 0, 0, "theriver99XY-_ab", 'my key = "', '" end')], "finding long, doc_id long, path string, number int, start long, value string, before string, after string")
    pairs = spark.createDataFrame([("th", -1.0), ("he", -2.0)], "pair string, chance double")
    common = spark.createDataFrame([("the",), ("river",), ("her",)], "word string")
    row = op.featured(found, pairs, common).first()
    assert row.length == 16 and row.kind_changes == 5 / 16 and row.digit_share == 2 / 16 and row.capital_share == 2 / 16
    assert row.covered == 8 / 16 and abs(row.pair_likelihood - (-1 - 2 + 13 * op.UNSEEN) / 15) < 1e-9
    assert row.names_secret == row.assigned == row.quoted == row.path_examples == 1 and row.path_depth == 3 and row.distance == 4


def test_labelled_findings_of_the_caller_and_few_labels(spark, documents):
    rng = random.Random(5)
    docs = documents([(k, case(rng, k)[0]) for k in range(40)])
    folder = shared_folder(spark)
    labelled = op.findings(docs, folder).withColumn("label", (F.length("value") == 16).cast("int"))
    got = op.scan(docs, labelled).collect()
    assert all(r.is_secret == (len(r.value) == 16) for r in got)
    assert {r.score for r in op.scan(docs, labelled.filter("label = 1")).collect()} == {1.0}
    assert {r.score for r in op.scan(docs, labelled.limit(0)).collect()} == {0.0}
    assert op.scan(documents([])).count() == 0


def test_words_of_all_documents_are_counted(spark):
    # Each document has a word of its own (digits as letters); as many documents as a sample would leave some out.
    own = lambda k: "w" + "".join(chr(97 + int(d)) for d in f"{k:04d}")
    docs = spark.createDataFrame([(k, f"the {own(k)} zq{'zq' * (k == 4999)}zq") for k in range(5000)], "doc_id long, text string")
    pairs, common = op.ordinary_words(docs, shared_folder(spark))
    assert {r.word for r in common.collect()} == {"the", "zqzq", "zqzqzq", *map(own, range(5000))}
    assert abs({r.pair: r.chance for r in pairs.collect()}["qz"]) < 1e-9


def test_values_assigned_to_a_secrets_name_have_no_least_length(spark):
    texts = ['a password = "Tr0ub4dor&3" b', "PWD: x1!y@z", '{"api_key":"ab.c$d:9%e","n":1}', "token = 'ab12cd34'", 'key = ""', "nothing here", "é secret=" + "a1" * 10 + " z"]
    got = op.findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shared_folder(spark))
    rows = op.known_shapes(got).collect()
    want = {0: "Tr0ub4dor&3", 1: "x1!y@z", 2: "ab.c$d:9%e", 3: "ab12cd34", 6: "a1" * 10}
    assert sorted((r.doc_id, r.value) for r in rows) == sorted(want.items())
    assert all(texts[r.doc_id][r.start :].startswith(r.value) and r.label == 1 and r.number == 0 for r in rows)
