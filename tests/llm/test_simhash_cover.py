import random

import numpy as np
import xxhash

from chartloom.llm import simhash_cover as op
from chartloom.llm.shared import shared_folder


def slow_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(rows):
    prints = [slow_simhash(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, f"{prints[i]:016x}", best[find(i)]) for i, (d, _) in enumerate(rows))


def test_every_close_pair_shares_a_home_anchor():
    rng = random.Random(3)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(3)):
            y ^= 1 << b
        _, anchors, home = op.anchors_of(np.array([x], np.uint64))
        _, others, _ = op.anchors_of(np.array([y], np.uint64))
        assert home.sum() == 1 and anchors[home][0] in set(others.tolist())


def test_documents_match_brute_force(documents):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "One TWO"), (105, "É é"), (106, "a b c")]
    for k in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(3, 400))]
        for c in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(c):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((k * 10 + c + 1000, " ".join(words)))
    rows += rows[:3]
    got = op.near_groups(documents(rows)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute_components(rows)


def test_crowded_anchors_lose_no_link(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(60):
            v = center
            for b in rng.sample(range(64), rng.randrange(4)):
                v ^= 1 << b
            prints.add(v)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    folder = shared_folder(spark)
    for direct in (512, 4):
        sub = f"{folder}/{direct}"
        edges = op.links(spark.createDataFrame([(s,) for s in signed], "bits long"), sub, direct)
        roots = {r.node: r.root for r in op.components(edges, sub).collect()}
        got = [roots.get(s, s) for s in signed]
        label = list(range(len(prints)))
        for i in range(len(prints)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
        assert len(set(got)) == len(set(label)) == len(set(zip(got, label)))


def test_empty_table_and_one_of_a_group(documents):
    assert op.near_groups(documents([])).count() == 0
    docs = documents([(1, "a b c d"), (2, "a b c d"), (3, "x y z")])
    out = op.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_replicas_are_never_broadcast(spark, documents):
    """A broadcast would build what a small source has grown to."""
    distinct = spark.createDataFrame([(i,) for i in range(50)], "bits long")
    homes = spark.createDataFrame([(i,) for i in range(50)], "anchor long")
    points = op.grown(op.midpoints(distinct)).join(spark.createDataFrame([(1, 2)], "point long, a long"), "point")
    for joined in (op.meet(distinct, homes), points):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
