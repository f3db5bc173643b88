import hashlib
import pathlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import Row

from chartloom.llm import merkle_manifest as op

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, n int, digest string, chunk int, path int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = [row[c] for c in op.LEAF_COLUMNS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Top of a list of digests, and every node's siblings as (left?, digest or None)."""
    proofs, group = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for k, members in enumerate(group):
            other = k ^ 1
            for i in members:
                proofs[i].append((other < k, nodes[other] if other < len(nodes) else None))
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        group = [sum(group[k : k + 2], []) for k in range(0, len(group), 2)]
    return nodes[0], proofs


def brute(rows):
    langs, out = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())), []
    parts = {
        g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"], leaf(r)) if r["doc_id"] is not None else (False, 0, leaf(r)))
        for g in langs
    }
    trees = {g: tree([leaf(r) for r in parts[g]]) for g in langs}
    root, upper = tree([trees[g][0] for g in langs]) if langs else (None, [])
    for g, above in zip(langs, upper, strict=True):
        subroot, proofs = trees[g]
        for r, proof in zip(parts[g], proofs, strict=True):
            proof = proof + above
            changed = dict(r)
            if r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                changed["n_chars"] += 1
            node = leaf(changed)
            for on_left, other in proof:
                node = sha((other or "") + node if on_left else node + (other or ""))
            out.append((r["doc_id"], leaf(r), subroot, root, sha("".join(d or "" for _, d in proof)), node, node == root))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([Row(**r, tree="t", pos=1, n=2, digest="d", chunk=3, path=4) for r in rows], SHAPE)


def made(count, seed=1):
    rng = random.Random(seed)
    rows = [
        {"doc_id": i, "text": "é" * rng.randrange(4) + "x" * i, "lang": rng.choice(["en", "en", "en", "de", "ü", None]), "source": "s", "n_chars": rng.randrange(99)}
        for i in rng.sample(range(-5, 10 * count + 5), count)
    ]
    rows += [
        {"doc_id": None, "text": None, "lang": "en", "source": None, "n_chars": None},
        {"doc_id": None, "text": "", "lang": "lone", "source": "", "n_chars": 0},
        {"doc_id": 7, "text": "word " * 50_000, "lang": "", "source": "s", "n_chars": None},
    ]
    return rows + rows[:3] + rows[:1]


@pytest.mark.parametrize("count, step", [(70, 1), (70, 2), (90, 3), (40, 10)])
def test_matches_a_plain_tree(spark, count, step):
    rows = made(count, count)
    got = op.checked(table(spark, rows), step=step)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_trees_of_every_small_size(spark):
    rows = [{"doc_id": i, "text": "t", "lang": f"g{size:02d}", "source": "s", "n_chars": i} for size in range(1, 18) for i in range(size)]
    assert sorted(map(tuple, op.checked(table(spark, rows), step=2).collect()), key=str) == brute(rows)


def test_one_group_is_its_own_root_and_empty_tables_have_no_rows(spark):
    rows = [{"doc_id": 1, "text": "a", "lang": "en", "source": "s", "n_chars": 1}]
    (only,) = op.checked(table(spark, rows)).collect()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == sha("") and only.verified
    assert op.checked(table(spark, [])).count() == 0


def test_manifest_of_other_columns(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "part long, seq string")
    rows = op.manifest(docs, columns=["seq", "part"], group="seq", key="part").collect()
    assert len(rows) == 3 and len({r.root for r in rows}) == 1
    assert next(r for r in rows if r.part == 3).leaf == sha("-1:3")


def test_sql_agrees(spark, tmp_path):
    rows = [r for r in made(30, 4) if r["doc_id"] is not None]
    rows = list({r["doc_id"]: r for r in rows}.values())
    docs = table(spark, rows).drop("tree", "pos", "n", "digest", "chunk", "path")
    docs.toPandas().to_parquet(pathlib.Path(tmp_path, "d.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    got = con.execute(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({op.OP11_SQL})").fetchall()
    assert sorted(got, key=str) == brute(rows)


def test_no_task_sees_a_whole_group(spark):
    plan = op.climb(spark.range(10).selectExpr("'a' tree", "id pos", "10L n", "'d' digest"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(tree" in plan and "chunk" in plan
