import pytest

from chartloom.operators import abstraction
from chartloom.plans.cohort import abstract_cohort
from chartloom.sources import sinks, tables

N = "note_id string, visit_occurrence_id string, note_date string, note_datetime string, note_title string, note_text string"
M = "visit_occurrence_id string, measurement_id string, measurement_datetime string, measurement_name string, value_as_number double, value_as_string string, unit string"
D = "visit_occurrence_id string, drug_exposure_id string, drug_start_datetime string, drug_end_datetime string, drug_name string, route string, dose_rate string, drug_class string"
C = "visit_occurrence_id string, culture_id string, collection_datetime string, source string, organism string, result string"
V = "visit_occurrence_id string, person_id long, icu_admit_datetime string"


@pytest.fixture(scope="module")
def inputs(spark):
    notes = [
        ("1", "11", None, "2026-03-04 10:00", "Discharge Summary", "Admitted 2026-03-01 with septic shock from E. coli. lactate of 4.2, HR 118"),
        ("2", "12", None, "2026-03-04 10:00", "Discharge Summary", "Elective repair, uneventful."),
        ("3", "13", None, "2026-03-01 10:00", "H&P", "Concern for infection. vasoplegia noted; pneumonia on CXR"),
        ("4", "14", None, "2026-03-01 10:00", "Discharge Summary", "possible septic picture, not confirmed"),
    ]
    measurements = [("13", "m1", "2026-03-01 11:00", "Lactate", 3.0, None, None), ("13", "m2", "2026-03-01 11:00", "Temp", 39.0, None, "C"),
                    ("14", "m3", "2026-03-01 11:00", "Temp", 37.0, None, "C")]
    drugs = [("13", "d1", "2026-03-01 12:00", "2026-03-03 12:00", "Cefepime", "IV", None, None)]
    cultures = [("13", "c1", "2026-03-01 12:00", "Blood", "Klebsiella", "(+)")]
    visits = [(v, int(v), "2026-03-01 08:00") for v in ("11", "12", "13", "14", "15")]
    return [spark.createDataFrame(rows, schema) for rows, schema in ((notes, N), (visits, V), (measurements, M), (drugs, D), (cultures, C))]


@pytest.fixture(scope="module")
def result(inputs):
    return abstract_cohort(*inputs, run_ts="t", institution="7")


def test_gate_flow(result):
    rows = {r.vid: r for r in result.survey.collect()}
    assert [rows[v].sepsis_ync_v3 for v in ("11", "12", "13", "14", "15")] == ["1", "2", "3", "3", "3"]
    assert rows["13"].sepsis_uncertain_v3 == "1" and rows["14"].sepsis_uncertain_v3 == "2"
    assert rows["15"].sepsis_uncertain_v3 == ""
    assert rows["11"].sep6_v3 == "4.2" and rows["11"].sep1_v3___2 == "1" and rows["11"].sep1_v3___1 == ""
    assert "[DATE REDACTED]" in rows["11"].sep5_v3 and rows["11"].conf1 == "" and rows["11"].concept_1_v3___1 == "1"
    assert rows["13"].sep3_v3 == "Blood, Klebsiella, (+)" and rows["13"].sep4_v3 == "1" and rows["13"].sep6_v3 == "3"
    assert [rows["13"][f"sep_surg_v3___{c}"] for c in "12349"] == ["0", "1", "0", "0", "0"]
    assert rows["13"].sep5_v3.startswith("Concern for infection") and rows["12"].sep4_v3 == ""


def test_status(result):
    rows = {r.vid: r for r in result.adjudications.collect()}
    assert (rows["11"].phenotype_status, rows["11"].confidence_score) == ("CONFIRMED_POSITIVE", 0.94)
    assert (rows["12"].phenotype_status, rows["12"].confidence_score) == ("CONFIRMED_NEGATIVE", 0.90)
    assert (rows["13"].phenotype_status, rows["13"].confidence_score) == ("SUSPECTED_PROBABLE", 0.78)
    assert (rows["14"].phenotype_status, rows["14"].confidence_score) == ("CONFIRMED_NEGATIVE", 0.85)
    assert rows["15"].phenotype_status == "INDETERMINATE_INSUFFICIENT_DATA" and "UNKNOWN" in rows["15"].review_flags
    assert "sep1_v3___1: neither tables nor notes tell" in rows["11"].review_flags


def test_evidence_and_export(spark, result, tmp_path):
    rows = result.evidence.collect()
    assert {"sepsis_ync_v3", "sep5_v3"} <= {r.field_name for r in rows if r.vid == "11"}
    assert any(r.source_ref == "note:1" for r in rows)
    fields = spark.createDataFrame([(1, "a", "text", "A", {"1": "x"}, "")],
                                   "field_order long, field string, field_type string, label string, choices map<string,string>, branching string")
    manifest = sinks.abstraction_manifest(result.adjudications, fields, "t")
    row = manifest.first()
    assert row.encounters_processed == 5 and row.status_counts["CONFIRMED_NEGATIVE"] == 2 and len(row.dictionary_sha256) == 64
    paths = sinks.write_abstraction(result.survey, result.adjudications, result.evidence, manifest, str(tmp_path))
    assert spark.read.option("header", True).csv(paths["survey_import"]).count() == 5


def test_outside_answers_are_grounded_and_fail_closed(spark, inputs):
    quote = abstraction.QUOTE
    s1 = spark.createDataFrame([
        ("11", "1", True, [("x", 1, "septic   shock from E. coli", "clinical_note"), ("x", 1, "never written down here", "clinical_note"),
                           ("x", 1, "Admitted with coli shock", "clinical_note")], "r"),
        ("12", "1", True, [], "r"), ("13", "3", False, [], "r"), ("14", "2", False, [], "r")],
        f"vid string, gate string, concept boolean, quotes {quote}, rationale string")
    s2 = spark.createDataFrame([], f"vid string, follow_up string, quotes {quote}, rationale string")
    third = ("status string, score double, confounders array<string>, evidence_text string, lactate_text string, "
             "sep1_v3___1_said string, sep1_v3___2_said string, sep1_v3___3_said string, sep1_v3___4_said string, culture_said string, "
             "course_said string, score_said string, rise_said string, onset_said string, days_said string, rationale string")
    rest = (["9", "4"], "", None, "YES", "NO", "UNKNOWN", "UNKNOWN", None, "CONFIRMED", None, None, None, None, "r3")
    s3 = spark.createDataFrame([("11", [], "CONFIRMED_POSITIVE", 0.9, *rest), ("12", [], "CONFIRMED_POSITIVE", 0.9, *rest)],
                               f"vid string, quotes {quote}, {third}")
    out = abstract_cohort(*inputs, run_ts="t", answers=abstraction.StageAnswers(s1, s2, s3), backend="outside", model="m")
    status = {r.vid: r for r in out.adjudications.collect()}
    assert status["13"].phenotype_status == "INDETERMINATE_INSUFFICIENT_DATA" and "missing_stage2" in status["13"].review_flags
    assert status["12"].inference_backend.endswith(":ungrounded_hold")
    quotes = [r.evidence_quote for r in out.evidence.collect() if r.vid == "11" and r.field_name == "sepsis_ync_v3"]
    assert sorted(quotes) == ["Admitted with coli shock", "septic   shock from E. coli"]
    row = {r.vid: r for r in out.survey.collect()}["11"]
    assert (row.sep1_v3___1, row.sep1_v3___2, row.sep4_v3, row.sep_surg_v3___9) == ("1", "0", "1", "1")


def test_prompt_audit(spark):
    fields = tables.instrument(spark.createDataFrame([
        (1, "sepsis_ync_v3", "radio", "Gate", "1, Yes | 2, No | 3, I am not sure", ""),
        (2, "sep1_v3", "checkbox", "SIRS", "1, <b>Temperature</b> &gt;38 | 2, HR > 90", "[sepsis_ync_v3]='1'"),
        (3, "sep_surg_v3", "checkbox", "Confounder", "1, Yes - major surgery | 4, No | 9, Unclear given notes", ""),
        (4, "sep7_v3", "text", "SOFA", "", ""), (5, "conf1", "radio", "Conf", "1, low", "")],
        "field_order long, `Variable / Field Name` string, `Field Type` string, `Field Label` string, "
        "`Choices, Calculations, OR Slider Labels` string, `Branching Logic (Show field only if...)` string"))
    prompts = spark.createDataFrame([
        ("1", "sepsis_ync_v3", "radio", "Sepsis?", "Answer YES or NO."),
        ("2", "sep1_v3___1", "checkbox", "Temp > 38 ?C", "YES or NO"),
        ("3", "sep_surg_v3___4", "checkbox", "Vasoplegia comment", "UNKNOWN allowed"),
        ("4", "sep7_v3", "text", "SOFA", "  "), ("5", "conf1", "radio", "Confidence", "x"), ("6", "sep1_v3___7", "checkbox", "x", "")],
        "QID string, Code string, UI string, Question string, Prompt string")
    found = {(r.code, r.issue_type) for r in abstraction.audit_prompts(prompts, fields).collect()}
    assert found == {
        ("sepsis_ync_v3", "forced_binary_on_three_way_gate"), ("sepsis_ync_v3", "missing_choices_or_branching"),
        ("sep1_v3___1", "encoding_mojibake"), ("sep1_v3___1", "missing_unknown_option"),
        ("sep_surg_v3___4", "choice_code_mismatch"), ("sep7_v3", "unhandled_quantitative_or_temporal_field"),
        ("conf1", "human_only_field"), ("sep1_v3___7", "choice_code_mismatch")}
