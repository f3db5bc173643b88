import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import agreement, intervals
from chartloom.plans import catalog
from chartloom.sources import sinks
from chartloom.skew import first_n, join_spread, number_rows


def walk(rows):
    """Episodes by walking the sorted intervals of one key."""
    out = []
    for s, e, tr, ref in sorted(rows, key=lambda r: (r[0], r[3])):
        e = max(s, e)
        if out and (s - out[-1][1]).total_seconds() / 3600 <= (48 if tr or out[-1][2] else 24):
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] or tr, out[-1][3])
        else:
            out.append((s, e, tr, ref))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_episodes_against_walk(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2026, 1, 1)
    rows = []
    for vid in range(40):
        at = start
        for n in range(rng.randint(1, 25)):
            at += dt.timedelta(hours=rng.choice([0, 1, 5, 20, 24, 25, 30, 47, 48, 49, 60, 90]))
            rows.append((vid, at, at + dt.timedelta(hours=rng.choice([-2, 0, 1, 4, 30])), rng.random() < 0.15, f"r{n:02d}"))
    df = spark.createDataFrame(rows, "vid long, start_time timestamp_ntz, end_time timestamp_ntz, is_trough boolean, ref string")
    got = sorted((r.vid, r.start_time, r.end_time, r.is_trough, r.ref) for r in intervals.merge_episodes(df).collect())
    want = sorted((vid, *ep) for vid in range(40) for ep in walk([r[1:] for r in rows if r[0] == vid]))
    assert got == want


def test_helpers_on_a_hot_key(spark):
    df = spark.range(20000).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 7))
    top = first_n(df, ["k"], [F.col("id").desc()], 2, spread=("id",), pieces=4)
    assert {(r.k, r.id) for r in top.filter("k = -1").collect()} == {(-1, 19998), (-1, 19995)}
    numbered = number_rows(df, [F.col("id")], F.floor(F.col("id") / 500), "n", keys=["k"])
    hot = numbered.filter("k = -1").agg(F.min("n"), F.max("n"), F.count_distinct("n"), F.count("n")).first()
    assert list(hot) == [1, 6667, 6667, 6667]
    small = spark.createDataFrame([(-1, "hot"), (3, "three")], "k long, name string")
    assert join_spread(df, small, ["k"], F.col("id"), 4).filter("name = 'hot'").count() == 6667


PAIRS = "human_positive boolean, llm_positive boolean"


@pytest.mark.parametrize("rows, expected", [
    ([(True, True), (False, False)] * 2, (4, 100.0, 1.0)),
    ([(True, True), (True, False), (False, True), (False, False)], (4, 50.0, 0.0)),
    ([(True, None), (None, False), (True, True), (False, False)], (2, 100.0, 1.0)),
    ([(True, True)], (1, 100.0, 1.0)),
    ([], (0, 0.0, 0.0)),
])
def test_binary(spark, rows, expected):
    row = agreement.binary_agreement(spark.createDataFrame(rows, PAIRS)).first()
    assert (row.total_evaluated, row.overall_agreement_pct, row.cohens_kappa) == expected


S = ("institution_v3 string, record_id string, vid string, sepsis_ync_v3 string, sepsis_uncertain_v3 string, sep1_v3___3 string, "
     "sep3_v3 string, sep6_v3 string, sep7_v3 string, sep_day_v3 string, sep_dt_v3 string, sep_days string, conf1 string")


def test_two_survey_tables(spark, tmp_path):
    human = spark.createDataFrame([
        ("A", "1", "10", "1", "", "1", "Blood, E. coli, (+)", "3.7", "0, 4", "1", "02:00", "1", "5"),
        ("A", "2", "20", "3", "1", "0", "NO", "2", "2", "", "03:00", "0", "2"),
        ("A", "3", "30", "2", "", "", "", "", "", "", "", "", "4"), ("A", "4", "40", "2", "", "", "", "", "", "", "", "", "4"),
        ("A", "5", "50", "1", "", "", "", "", "", "", "", "", "")], S)
    model = spark.createDataFrame([
        ("A", "1", "10", "1", "", "", "Blood, E. coli, (+)", "3.9", "0, 5", "1", "02:30", "1", ""),
        ("A", "2", "20", "1", "", "0", "Blood, Klebsiella, (+)", "2.0", "2", "", "03:30", "0", ""),
        ("A", "3", "30", "1", "", "", "", "", "", "", "", "", ""), ("A", "4", "40", "2", "", "", "", "", "", "", "", "", "")], S)
    evidence = spark.createDataFrame([("2", "20", "sep3_v3", "second", "b", 2), ("2", "20", "sepsis_ync_v3", "first", "a", 1)],
                                     "record_id string, vid string, field_name string, evidence_quote string, source_ref string, evidence_order int")
    out = agreement.evaluate(human, model, evidence)
    assert list(out["keys"].first()) == [4, 1, 0, 2]
    cells = {(r.human, r.model): r.n for r in out["gate_matrix"].collect()}
    assert cells["1", "1"] == 1 and cells["3", "1"] == 1 and sum(cells.values()) == 4
    gate = out["gate"].first()
    assert gate.linear_weighted_kappa >= gate.unweighted_kappa
    resolved = out["resolved"].first()
    assert (resolved.tp, resolved.fp, resolved.fn, resolved.tn) == (2, 1, 0, 1)
    items = {r.field: r for r in out["items"].collect()}
    assert items["sep1_v3___3"].llm_missing_count == 1 and items["sep3_v3_positive"].organism_jaccard_mean == 1.0
    numeric = {r.metric: r for r in out["numeric"].collect()}
    assert numeric["lactate_error"].mean_error == 0.1 and numeric["lactate_error"].median_error == 0.1
    assert numeric["score_peak_error"].mean_error == 0.5 and numeric["onset_hour_error"].mean_error == 0.5
    found = {(r.vid, r.field): r for r in out["discrepancies"].collect()}
    assert set(found) == {("20", "sepsis_ync_v3"), ("30", "sepsis_ync_v3"), ("30", "gate_resolved"), ("20", "sep3_v3_positive")}
    assert found["20", "sep3_v3_positive"].llm_evidence_quote == "first" and found["30", "gate_resolved"].llm_evidence_quote == ""
    report = agreement.report(out)
    assert "## Discrepancies (4)" in report
    paths = sinks.write_concordance(out, report, str(tmp_path))
    assert spark.read.json(paths["keys"]).first().matched_encounters == 4


def test_join_keys_need_every_row(spark):
    full = spark.createDataFrame([("A", "1", "v")], "institution_v3 string, record_id string, vid string")
    gap = spark.createDataFrame([("A", "", "v")], "institution_v3 string, record_id string, vid string")
    assert agreement.join_keys(full, full) == ["institution_v3", "record_id", "vid"]
    assert agreement.join_keys(full, gap) == ["institution_v3", "vid"]


def test_registry():
    assert set(catalog.CHECKS) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 55
