import hashlib
import random
import re

import pytest

from chartloom.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for p in range(len(w)):
            for n in range(1, 11):
                if p + n <= len(w) and tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture
def case():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)] + ["É", "ÀB", "été"]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, line(rng.randrange(5, 30))) for i in range(12)] + [(50, None), (51, "..."), (52, "w1 w2 w3"), (53, "É"), (54, "w1 w2 w3")]
    items += items[:2]
    docs = []
    texts = [t for _, t in items if t]
    for i in range(40):
        text = line(rng.randrange(0, 40))
        if i % 2:
            text += " " + rng.choice(texts).replace(" ", ", ").replace("w", "W") + ". " + line(5)
        docs.append((100 + i, text))
    docs += [(1, None), (2, ""), (3, "!!"), (None, "w1 w2 w3"), docs[1], docs[1]]
    return docs, items


@pytest.mark.parametrize("most", [op.BROADCAST_HASHES, 0])
def test_hits_match_brute_force(spark, documents, case, most):
    docs, items = case
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    got = op.hits(documents(docs), bench, most=most)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, items)


def test_documents_and_spans_are_removed(spark, documents):
    item = "a b c d e f g h i j k"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents([(1, "Start; A b, c d e f g h i j k! End."), (2, "clean"), (3, None)])
    assert sorted(r.doc_id for r in op.drop_documents(docs, bench).collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in op.cut_spans(docs, bench).collect()}
    assert cut == {1: "Start; ! End.", 2: "clean", 3: None}
    assert op.cut_spans(docs, bench).columns == docs.columns


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op.hits(documents([]), bench).count() == 0
    assert [r.n_hit for r in op.hits(documents([(1, "a b")]), bench).collect()] == [0]


def test_many_hashes_with_long_and_alike_documents(spark, documents):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))
    items = [(i, line(30)) for i in range(40)] + [(90, "two words")]
    shared = items[3][1]
    docs = [(1, f"{line(10_000)} {items[5][1]} {line(10_000)} Two, Words")]
    docs += [(10 + i, f"x{i} {shared} y") for i in range(10_000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = op.hits(documents(docs), bench, most=0)
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()]
    assert sorted(rows, key=str) == brute(docs, items)


def test_words_stay_out_of_the_join_on_hashes(spark, documents):
    tests = op.windows_of(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    plan = op._scan_by_shuffle(documents([(1, "a b c d")]), tests.select("h"), [3], 10)._jdf.queryExecution().sparkPlan().toString()
    joins = [part for part in plan.split("SortMergeJoin")[1:] if "LeftSemi" in part.split("\n")[0]]
    assert len(joins) == 1 and "Generate inline" in joins[0].split("LeftSemi")[1]
    generate = re.search(r"Generate inline\(.*\), \[([^\]]*)\], false", joins[0])
    assert "words" not in generate[1] and "text#" not in generate[1]
