import hashlib
import random
from collections import defaultdict

import numpy as np

from chartloom.llm import poly_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(
        ((i, max(g, key=lambda x: (x is not None, x)), len(g), hashlib.sha256((t or "").encode()).hexdigest())
         for i, t in rows for g in [groups[t or ""]]), key=str,
    )


def test_hashes_compose():
    table = op.powers(count=64)
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(2, 100)))
        cut = rng.randrange(0, len(data), 2)
        left, _ = op.chunk_hash(data[:cut], table)
        right, n = op.chunk_hash(data[cut:], table)
        assert op.compose(left, right, table[n]) == op.chunk_hash(data, table)[0]


def test_hash_is_the_polynomial():
    data = np.array([3, 5, 7], np.uint16).tobytes()
    b = op.BASES[0]
    assert op.chunk_hash(data, op.powers(count=8))[0][0] == (3 * b * b + 5 * b + 7) % op.PRIME


def test_groups_match_brute_force(documents):
    long = "word " * 60_000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long + "x"), (None, "b"), (None, "b"), (9, "b"), (9, "b"), (10, "é"), (-1, "only")]
    got = op.exact_groups(documents(rows)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_chunks_of_huge_texts_are_hashed_in_parallel(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdé ") for _ in range(100 * op.CHUNK))
    texts = [long, long, long[:-1] + "x", "a" * (2 * op.CHUNK), "b" * (2 * op.CHUNK + 1), "é" * op.CHUNK, "odd"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert len(long.encode()) > 100 * op.CHUNK and op._pieces(df).filter("chunk = 100").count() == 2
    for prime in (op.PRIME, 11):
        table = op.powers(prime=prime)
        want = {hashlib.sha256(t.encode()).hexdigest(): (len(t.encode()), op.fingerprint(t.encode(), table, prime)) for t in texts}
        got = {r.text_sha256: (r.n_bytes, (r.h1 >> 31, r.h1 & op.PRIME, r.h2 >> 31, r.h2 & op.PRIME)) for r in op.huge_prints(df, prime).collect()}
        assert got == want


def test_huge_texts_are_grouped_like_others(documents):
    rows = [(i, t) for i, t in enumerate(["x" * 9, "x" * 9, "y" * 9, "short", "short", None, "ab" * op.CHUNK, "ab" * op.CHUNK, "ba" * op.CHUNK])]
    for prime in (op.PRIME, 2):
        got = op.exact_groups(documents(rows), prime=prime, huge=8).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)


def test_colliding_fingerprints_are_told_apart(documents):
    rows = [(i, f"{i % 37:03d}") for i in range(200)]
    got = op.exact_groups(documents(rows), prime=2).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)


def test_empty_table_and_kept_columns(documents):
    assert op.exact_groups(documents([])).count() == 0
    docs = documents([(1, "a"), (2, "a"), (2, "a"), (3, None)])
    out = op.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3]
