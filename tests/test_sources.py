import json

import pytest
from pyspark.sql import functions as F

from chartloom.operators import export, quality, rules, spans
from chartloom.schemas import ADJUDICATION, AUDIT
from chartloom.sources import sinks, tables
from chartloom.streaming import incremental

NOTES = "note_id,person_id,visit_occurrence_id,note_datetime,note_title,note_text\n" \
    '1,7,101,2026-01-01 10:00,Progress,"septic shock, treated\nsecond line"\n2,7,102.0,2026-01-02,Progress,all well\n' \
    "3,7,,2026-01-02,Progress,lost\n4,8,invalid,2026-01-02,Progress,lost\n"
VISITS = "Visit_Occurrence_Id ,person_id,visit_start_date,visit_end_date\n101,7,2026-01-01,2026-01-03\n102,,a,b\n103,9,a,b\n,9,a,b\n"


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_to_result_and_resume(spark, tmp_path):
    notes, visits = tables.load_chart_sources(spark, write(tmp_path / "n.csv", NOTES), write(tmp_path / "v.csv", VISITS))
    decided = rules.rule_adjudicate(notes, visits, "sepsis", "t")
    status = {r.visit_occurrence_id: r.phenotype_status for r in decided.collect()}
    assert status == {101: "CONFIRMED_POSITIVE", 102: "CONFIRMED_NEGATIVE", 103: "INDETERMINATE_INSUFFICIENT_DATA"}
    from chartloom.operators.charts import load_charts

    charts = load_charts(notes, visits)
    store = str(tmp_path / "store")

    def decide(todo):
        return rules.adjudicate_charts(todo, "sepsis", "t")

    first = incremental.run_increment(charts.filter("visit_occurrence_id = 101"), store, decide, "sepsis", "t")
    assert {r.phenotype_status: r.n for r in first.collect()} == {"CONFIRMED_POSITIVE": 1}
    out = str(tmp_path / "out")
    second = incremental.run_increment(charts, store, decide, "Sepsis / Septic Shock", "2026-01-01T00:00:00", out)
    assert sum(r.n for r in second.collect()) == 3
    assert incremental.pending(charts, incremental.stored_results(spark, store)).count() == 0
    omop = spark.read.option("header", True).csv(f"{out}/omop")
    assert sorted(r.value_as_concept_id for r in omop.collect()) == ["4181412", "4188540", "45877994"]
    assert spark.read.parquet(f"{out}/parquet").count() == 3


def test_caller_function_runs_on_executors(spark, tmp_path):
    import pandas as pd

    def always(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "person_id": batch.person_id, "visit_occurrence_id": batch.visit_occurrence_id, "condition_present": True,
            "phenotype_status": "CONFIRMED_POSITIVE", "confidence_score": 1.0,
            "primary_criteria_met": [[] for _ in range(len(batch))], "key_evidence": [[] for _ in range(len(batch))],
            "clinical_rationale": "x", "adjudication_timestamp": "t", "inference_backend": "f"})

    charts = spark.createDataFrame([(1, 5)], "person_id long, visit_occurrence_id long")
    assert incremental.decide_with(always)(charts).schema.names == ADJUDICATION.names
    assert incremental.decide_with(always)(charts).first().visit_occurrence_id == 5


def test_csv_rules(spark, tmp_path):
    assert tables.csv_encoding(spark, write(tmp_path / "a.csv", "a,b\né,1\n")) == "UTF-8"
    assert tables.csv_encoding(spark, write(tmp_path / "b.csv", "a,b\né,1\n", "cp1252")) == "windows-1252"
    assert tables.read_csv(spark, write(tmp_path / "c.csv", "\ufeffa,b\né,1\n")).first().asDict() == {"a": "é", "b": "1"}
    plain = write(tmp_path / "g.csv", 'a,b\n"x,""y""",1\nz,2\n')
    assert tables.read_csv(spark, plain, line_breaks=False).collect() == tables.read_csv(spark, plain).collect() != []
    assert tables.read_csv(spark, write(tmp_path / "d.csv", "a,b\né,1\n", "cp1252")).first().a == "é"
    for bad in ("a,a\n1,2\n", "\n"):
        with pytest.raises(ValueError):
            tables.read_csv(spark, write(tmp_path / "e.csv", bad))
    with pytest.raises(Exception):
        tables.read_csv(spark, write(tmp_path / "f.csv", "a,b\n1,2,3\n"), strict_width=True).collect()


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    lines = ['{"visit_occurrence_id": 1, "human_decision": "Override: Mark Positive"}', "", '{"visit_occ', "[1]", "7",
             json.dumps({"visit_occurrence_id": 2, "llm_status": "CONFIRMED_POSITIVE"})]
    rows, skipped = tables.read_json_lines(spark, write(tmp_path / "log.jsonl", "\n".join(lines)), AUDIT)
    assert rows.count() == 2 and skipped.first().skipped == 3
    audit = {r.visit_occurrence_id: r for r in export.normalize_audit(rows, "now").collect()}
    assert audit[1].human_positive and not audit[1].llm_positive and audit[1].reviewer_id == "physician_01"
    assert audit[2].human_positive and audit[2].llm_positive and audit[2].timestamp == "now"
    assert export.audit_agreement(rows).first().total_evaluated == 2


def test_safe_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "-5", " @x", None, ["a"])], "a string, b string, c string, d string, e array<string>")
    sinks.write_csv(df, str(tmp_path / "o"))
    row = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("'=1+1", "-5", "' @x", None, '["a"]')


def test_criteria_store(spark, tmp_path):
    path = str(tmp_path / "criteria")
    assert sinks.load_criteria(spark, path) is None
    sinks.save_criteria(spark, " own text ", path)
    saved = sinks.load_criteria(spark, path)
    configured = {"sepsis": "c"}
    assert rules.resolve_criteria("Sepsis", None, saved, configured) == "own text"
    assert rules.resolve_criteria("Sepsis", "mine", saved, configured) == "mine"
    assert rules.resolve_criteria("Septic", "consensus criteria", None, configured) == "c"
    assert rules.resolve_criteria("Gout") == "Standard Consensus Definition"


def test_span_bundle(spark, tmp_path):
    write(tmp_path / "notes.csv", "row_id,hadm_id,subject_id,text\n1,9001,5,no sepsis but fever\n2,9002,6,sepsis here\n")
    write(tmp_path / "labels.csv", "row_id,trigger_word,concept,semtypes,start,end,detection,encounter,negation\n"
          "1,sepsis,Sepsis,dsyn,3,9,yes,yes,yes\n2,sepsis,Sepsis,dsyn,0,6,yes,yes,no\n1,fever,Fever,SOSY,14,19,no,yes,yes\n")
    notes, labels = tables.load_span_bundle(spark, str(tmp_path))
    gold = {r.visit_occurrence_id: r.human_positive for r in spans.phenotype_gold(notes, labels, "Sepsis / Septic Shock").collect()}
    assert gold == {9001: False, 9002: True}
    assert all(r.f1 == 1.0 for r in spans.task_scores(labels, labels).collect())
    flipped = labels.withColumn("detection", F.when(F.col("row_id") == 2, "no").otherwise(F.col("detection")))
    worse = {r.task: r for r in spans.task_scores(labels, flipped).collect()}
    assert worse["detection"].f1 < 1 and worse["detection"].fn == 1
    with pytest.raises(ValueError, match="undetected"):
        tables.load_span_bundle(spark, str(tmp_path), normalize_undetected=False)
    omop, visits = spans.omop_bundle(notes)
    paths = sinks.write_span_bundle(omop, visits, str(tmp_path / "out"), spans.bundle_manifest(notes, labels), labels)
    assert json.loads(spark.read.text(paths["manifest"]).first().value) == {"n_notes": 2, "n_visits": 2, "n_labels": 3}
    assert spans.concept_prompts(notes, labels).count() == 3
    assert quality.missing_predictions(labels, labels.filter("row_id = 1")).count() == 1
