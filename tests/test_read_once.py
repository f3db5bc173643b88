"""Labels and decisions that are read several times are made once."""

import pytest

from chartloom.plans import check_queries, text_queries
from chartloom.sources import sinks


def _tables(spark, documents, folder):
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return _tables(spark, [(k, f"patient was septic {k} and fever le x", "en", "web", 9) for k in range(12)], tmp_path_factory.mktemp("t"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_made_once(spark, folder):
    assert "n_chars" not in _plan(text_queries.task_prf(spark, folder)) and "Relation" not in _plan(text_queries.task_prf(spark, folder))


def test_decisions_are_made_once(spark, folder, monkeypatch):
    plans = []
    written = sinks.write_batch
    monkeypatch.setattr(sinks, "write_batch", lambda df, *more: plans.append(_plan(df)) or written(df, *more))
    appended = sinks.append_json
    monkeypatch.setattr(sinks, "append_json", lambda df, *more: plans.append(_plan(df)) or appended(df, *more))
    assert check_queries.batch_round_trip(spark, folder).count() == 48
    check_queries.committed_runs(spark, folder).collect()
    # The notes are regrouped before they are read for rules; no write starts there again.
    assert len(plans) > 3 and not any("Generate posexplode" in p for p in plans)
