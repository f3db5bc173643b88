import json
import uuid

import pytest
from pyspark.sql import functions as F

from chartloom.schemas import ADJUDICATION
from chartloom.streaming import committed


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def decide(todo):
    known = {"person_id": F.lit(1).cast("long"), "visit_occurrence_id": F.col("visit_occurrence_id"), "phenotype_status": F.lit("CONFIRMED_NEGATIVE")}
    return todo.select(*(known.get(f.name, F.lit(None).cast(f.dataType)).cast(f.dataType).alias(f.name) for f in ADJUDICATION.fields))


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "visit_occurrence_id long")


def rows(spark, store):
    return sorted((r.run_id, r.visit_occurrence_id) for r in committed.results(spark, store).collect())


def test_a_run_killed_before_its_commit_leaves_no_rows(spark, store):
    assert rows(spark, store) == [] and committed.abandoned(spark, store).isEmpty()
    left = committed.write_attempt(decide(ids(spark, 1, 2, 3)), store)
    assert rows(spark, store) == []
    committed.run(ids(spark, 1, 2), store, decide, "a b/c=1", "t")
    assert rows(spark, store) == [("a b/c=1", 1), ("a b/c=1", 2)]
    assert [r.attempt for r in committed.abandoned(spark, store).collect()] == [left]


def test_a_killed_write_of_rows(spark, store):
    fails = F.when(F.col("visit_occurrence_id") > 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x"))
    with pytest.raises(Exception, match="lost"):
        committed.append_run(decide(ids(spark, *range(8))).withColumn("phenotype_status", fails), store, "a", "t")
    assert rows(spark, store) == []
    assert committed.append_run(decide(ids(spark, 5)), store, "a", "t") and rows(spark, store) == [("a", 5)]


def test_committed_runs_are_not_repeated(spark, store):
    assert committed.append_run(decide(ids(spark, 1)), store, "a", "t")
    assert not committed.append_run(decide(ids(spark, 2)), store, "a", "t")
    counts = committed.run(ids(spark, 1, 2, 3), store, decide, "b", "t")
    assert rows(spark, store) == [("a", 1), ("b", 2), ("b", 3)] and not counts.isEmpty()
    assert committed.append_run(decide(ids(spark)), store, "none", "t")
    assert {r.run_id: r.row_count for r in committed.commits(spark, store).collect()} == {"a": 1, "b": 2, "none": 0}


def test_two_commits_of_one_run_count_once(spark, store):
    tries = sorted(committed.write_attempt(decide(ids(spark, 1, 2)), store) for _ in range(2))
    for attempt in reversed(tries):
        committed.commit(spark, store, "a", attempt, "t")
    assert rows(spark, store) == [("a", 1), ("a", 2)]


def test_history_is_taken_over(spark, store, tmp_path):
    old = tmp_path / "old.jsonl"
    old.write_text(json.dumps({"visit_occurrence_id": 7, "person_id": 1}) + "\n{broken\n\n")
    assert committed.adopt_history(spark, str(old), store, "history", "t")
    committed.run(ids(spark, 7, 8), store, decide, "next", "t")
    assert rows(spark, store) == [("history", 7), ("next", 8)]


def test_only_ids_of_committed_tries_are_read(spark, store):
    committed.append_run(decide(ids(spark, 1)), store, "a", "t")
    plan = committed.pending(ids(spark, 1, 2), committed.results(spark, store))._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "ReadSchema: struct<visit_occurrence_id:bigint>" in scan
