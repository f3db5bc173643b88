import importlib
import random

import pytest

import corpus_pipeline
from chartloom.llm import piece_codec
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_factor_quality import text as labelled_text
from tests.llm.test_simhash_cover import brute_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, " ".join(f"bench{rng.randrange(300)}" for _ in range(14))) for k in range(5)]
    labels, docs = [], []
    for k in range(400):
        good = int(rng.random() < 0.8)
        labels.append((k, good, 0))
        docs.append([k, labelled_text(rng, good)])
    for k in range(0, 60, 3):
        docs.append([1000 + k, docs[k][1]])
    for k in range(1, 60, 7):
        words = docs[k][1].split()
        docs.append([2000 + k, " ".join([*words[:-1], "changed"])])
    for k in range(60, 80):
        docs[k][1] += " " + rng.choice(items)[1]
    docs += [[3000, None], [3001, ""], [None, "a null id with some words"]]
    spark.createDataFrame([(*d, "en", "s", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [tuple(d) for d in docs], items


def test_stages_match_a_plain_version(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    rows = dict(docs)
    before = set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == columns
        got = {r.doc_id for r in frame.collect()}
        if name == "quality":
            good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
            want = {i for i in before if i not in range(400) or i in good}
            assert len(got.symmetric_difference(want) & set(range(400))) <= 8
        elif name == "exact_dedup":
            best = {}
            for i in before:
                best.setdefault(rows[i] or "", []).append(i)
            assert got == {max(v, key=lambda x: (x is not None, x or 0)) for v in best.values()}
        elif name == "near_dedup":
            known = [(i, rows[i]) for i in before if i is not None]
            assert got - {None} == {c for _, _, c in brute_components(known)}
        else:
            assert got == {r[0] for r in brute_hits([(i, rows[i]) for i in before], items) if not r[-1]}
        before = got


def test_run_encodes_what_stays(spark, tables):
    folder, docs, _ = tables
    got = corpus_pipeline.run(spark, folder).collect()
    library = piece_codec.sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    rows = dict(docs)
    assert got and all(r.n_tokens == len(library.encode(rows[r.doc_id] or "")) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "encoding"]


def test_registered(spark):
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
