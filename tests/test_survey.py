import pytest

from chartloom.operators import quality, survey
from chartloom.sources import sinks, tables

DICT = [
    ("sepsis_ync_v3", "radio", "Sepsis?", "1, Yes | 2, No"), ("sepsis_uncertain_v3", "radio", "Follow up", "1, Yes | 2, No"),
    ("sep1_v3", "checkbox", "SIRS", "1, Temperature | 2, Heart rate"), ("sep3_v3", "text", "Culture", ""),
    ("sep4_v3", "yesno", "Antibiotics", ""), ("sep5_v3", "text", "<b>Evidence</b>", ""), ("sep7_v3", "text", "SOFA", ""),
    ("sep_day_v3", "text", "Rise", ""), ("sep_calc", "calc", "x", ""),
    ("adhf_ync_v3", "radio", "ADHF", "1, Yes"), ("adhf2_v3", "radio", "Echo", "1, Low EF | 2, None of the above"),
    ("aki_ync_v3", "radio", "AKI?", "1, Yes"), ("aki1_v3", "yesno", "Creatinine", ""),
    ("del_ync_v3", "radio", "Delirium", "1, Yes"), ("afib_ync_v3", "radio", "AF", "1, Yes"), ("sei_ync_v3", "radio", "Seizure", "1, Yes"),
    ("shock_ync_v3", "radio", "Shock?", "1, Yes"), ("shock1_v3", "checkbox", "Elements", "1, systemic hypoperfusion | 2, elevated lactate > 2 mmol/L"),
    ("shock2_v4_sep", "radio", "Septic", "1, Description of septic shock | 2, b | 3, c | 4, 1 and 2 | 5, All of above"),
    ("stroke_ync_v3", "radio", "Stroke", "1, Yes"), ("did_the_patient_visit_have", "radio", "Arrest", "1, Yes"),
    ("ca_setting", "text", "Setting", ""), ("mortality_ca", "radio", "Died", "1, Yes"),
]
ROWS = [
    (2, "A", "r1", "v1", {"sep3_v3": "sepsis from coli", "sep1_v3___1": "1", "sep1_v3___2": "0", "aki1_v3": "1", "sepsis_ync_v3": "1"}),
    (3, "A", "r1", "v2", {"shock2_v4_sep": "4", "shock1_v3___1": "1"}),
    (4, "A", "r2", "v1", {"sep4_v3": "1", "sep5_v3": "pneumonia"}),
    (5, "B", "r9", "v9", {}),
]


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(i, *row) for i, row in enumerate(DICT)]
    return tables.instrument(spark.createDataFrame(
        rows, "field_order long, `Variable / Field Name` string, `Field Type` string, `Field Label` string, "
        "`Choices, Calculations, OR Slider Labels` string"))


@pytest.fixture(scope="module")
def rows(spark):
    columns = sorted({c for r in ROWS for c in r[4]})
    schema = "source_row long, institution_v3 string, record_id string, vid string, " + ", ".join(f"{c} string" for c in columns)
    return spark.createDataFrame([(*r[:4], *(r[4].get(c, "") for c in columns)) for r in ROWS], schema)


@pytest.fixture(scope="module")
def prepared(rows, fields):
    return survey.prepare_cases(rows, fields)


def test_instrument(fields):
    by = {r.field: r for r in fields.collect()}
    assert by["sep5_v3"].label == "Evidence" and by["shock2_v4_sep"].choices["4"] == "1 and 2"
    broken = fields.limit(1).unionByName(fields)
    assert {r.rule for r in tables.instrument_violations(broken, ["sep1_v3", "nope"]).collect()} == {"field_repeated", "field_missing"}


def test_cases_and_linkage(prepared):
    cases = {r.case_id: r for r in prepared.cases.collect()}
    assert len(cases) == 36
    assert cases["S02-P01"].linked_stay_count == 2 and cases["S02-P01"].visit_id_reused
    assert cases["S05-P01"].linked_stay_count == 1 and not cases["S05-P01"].visit_id_reused
    assert [cases[f"S0{n}-P01"].person_id for n in (2, 3, 4, 5)] == [1, 1, 2, 3]


def test_observations_are_masked_and_numbered(prepared):
    seen = [(r.record_id, r.observation, r.source_row, r.field, r.response) for r in
            prepared.observations.filter("target = 1").orderBy("record_id", "observation").collect()]
    assert seen == [
        ("r1", 1, 2, "sep1_v3", "Temperature"), ("r1", 2, 2, "sep3_v3", "sepsis from coli"), ("r1", 3, 2, "aki1_v3", "Yes"),
        ("r1", 4, 3, "shock1_v3", "systemic hypoperfusion"),
        ("r1", 5, 3, "shock2_v4_sep", "1 and 2 [dictionary expansion: 1. Description of septic shock; 2. b]"),
        ("r2", 1, 4, "sep4_v3", "Yes"), ("r2", 2, 4, "sep5_v3", "pneumonia")]
    fields_used = {r.field for r in prepared.observations.collect()}
    assert "sepsis_ync_v3" not in fields_used and "sepsis_uncertain_v3" not in fields_used


def result(case, status, quotes=(), rationale="", backend="hybrid:m:required_llm"):
    return (case, status, status in ("CONFIRMED_POSITIVE", "SUSPECTED_PROBABLE"), 0.9, [],
            [(None, None, q, "") for q in quotes], rationale, backend)


SCHEMA = ("case_id string, phenotype_status string, condition_present boolean, confidence_score double, primary_criteria_met array<string>, "
          "key_evidence array<struct<note_id:bigint,note_date:string,evidence_quote:string,interpretation:string>>, "
          "clinical_rationale string, inference_backend string")


def test_audit(spark, prepared, tmp_path):
    results = spark.createDataFrame([
        result("S02-P01", "CONFIRMED_POSITIVE", ["[O002] sep3_v3 (current stay):  sepsis from coli"]),
        result("S03-P01", "CONFIRMED_POSITIVE", ["[O002] sep3_v3 (current stay): sepsis from coli"]),
        result("S04-P01", "SUSPECTED_PROBABLE", ["[O001] sep4_v3 (current stay): Yes"]),
        result("S05-P01", "CONFIRMED_NEGATIVE"),
        result("S03-P07", "CONFIRMED_POSITIVE", ["[O001] shock1_v3 (current stay): systemic hypoperfusion"]),
        result("S02-P07", "SUSPECTED_PROBABLE", [], "lactate of 2 mmol"),
        result("S02-P03", "INDETERMINATE_INSUFFICIENT_DATA", backend="keyword_rules"),
    ], SCHEMA)
    found = {}
    for r in survey.audit_results(results, prepared).collect():
        found.setdefault(r.case_id, set()).add(r.check)
    assert "S02-P01" not in found and "S03-P07" not in found
    assert found["S03-P01"] == {"quote_not_a_line"}
    assert found["S04-P01"] == {"sepsis_unsupported"}
    assert found["S05-P01"] == {"no_exclusion_basis", "no_current_observations"}
    assert found["S02-P07"] == {"no_current_observations", "answer_without_quote", "shock_elements_missing", "lactate_invented"}
    assert found["S02-P03"] == {"aki_positive_expected"}
    first = survey.repair_round(results, prepared, 1)
    assert {r.case_id for r in first.passed.collect()} == {"S02-P01", "S03-P07"}
    prompts = {r.case_id: r.prompt for r in first.prompts.collect()}
    assert len(prompts) == 5 and "required model" in prompts["S02-P03"] and first.held.count() == 0
    last = survey.repair_round(results, prepared, 3, first.violations)
    assert last.prompts.count() == 0
    held = {r.case_id: r for r in last.held.collect()}
    assert len(held) == 5 and all(r.phenotype_status == "INDETERMINATE_INSUFFICIENT_DATA" for r in held.values())
    assert held["S05-P01"].inference_backend.endswith(":quality_hold")
    assert [r.case_id for r in survey.verified_evidence(results, prepared).orderBy("case_id").collect()] == ["S02-P01", "S03-P07", "S04-P01"]
    sheet = {r["Review ID"]: r for r in survey.review_sheet(results, prepared, first.violations).collect()}
    assert "Answers of several stays" in sheet["S02-P01"]["Review flags"] and "Kidney injury" in sheet["S02-P01"]["Review flags"]
    assert "share this visit id" in sheet["S04-P01"]["Review flags"] and "choice labels" in sheet["S03-P07"]["Review flags"]
    assert survey.run_figures(results, last.held).first().quality_holds == 5
    paths = sinks.write_review(survey.review_sheet(results, prepared), survey.verified_evidence(results, prepared), str(tmp_path))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths["review"]).count() == 7


def test_input_rules(spark, rows, fields):
    assert quality.linkage_violations(rows).count() == 0
    bad = rows.withColumn("aki1_v3", rows.vid)
    assert {r.rule for r in survey.coded_violations(bad, fields).collect()} == {"yes_no_code_invalid"}
    assert survey.case_texts(survey.prepare_cases(rows, fields)).filter("owner = 'S02-P01'").count() == 3


def test_rows_of_stays_are_never_broadcast(rows, fields, tmp_path):
    rows.write.parquet(str(tmp_path / "r"))  # a file gives Spark a size, which says little about the exploded rows
    read = survey.prepare_cases(rows.sparkSession.read.parquet(str(tmp_path / "r")), fields)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (read.cases, read.observations)]
    assert "BroadcastHashJoin" not in plans[0]
    assert "BuildRight" in plans[1] and "BuildLeft" not in plans[1]  # the dictionary alone
