"""Golden values of the structured facts."""

import pytest

from chartloom.operators import facts

M = "visit_occurrence_id string, measurement_id string, measurement_datetime string, measurement_name string, value_as_number double, value_as_string string, unit string"
D = "visit_occurrence_id string, drug_exposure_id string, drug_start_datetime string, drug_end_datetime string, drug_name string, route string, dose_rate string, drug_class string"
C = "visit_occurrence_id string, culture_id string, collection_datetime string, source string, organism string, result string"
V = "visit_occurrence_id string, person_id long, icu_admit_datetime string, visit_start_date string"


def compute(spark, visits, measurements, drugs, cultures, **options):
    tables = facts.chart_tables(
        spark.createDataFrame(visits, V), spark.createDataFrame(measurements, M), spark.createDataFrame(drugs, D),
        spark.createDataFrame(cultures, C),
    )
    table = facts.structured_facts(tables.anchors, tables.measurements, tables.drugs, tables.cultures, **options)
    return {row.vid: row for row in table.collect()}, facts.provenance(table, tables.cultures)


@pytest.fixture(scope="module")
def full(spark):
    day0, day1 = "2026-03-01", "2026-03-02"
    measurements = [
        ("7001.0", "m1", f"{day1} 02:00", "Temperature", 101.5, None, "F"),
        ("7001", "m2", f"{day1} 03:00", "HR", 82.0, None, None),
        ("7001", "m3", f"{day1} 03:00", "RR", 18.0, None, None),
        ("7001", "m4", f"{day1} 04:00", "WBC", 15500.0, None, None),
        ("7001", "m5", f"{day1} 04:00", "Lactate", 3.7, None, "mmol/L"),
        ("7001", "m6", f"{day1} 05:00", "Lactate", 3.7, None, "mmol/L"),
        ("7001", "m7", f"{day0} 23:30", "Platelets", 210.0, None, "K/uL"),
        ("7001", "m8", f"{day1} 06:00", "Platelets", 90.0, None, "K/uL"),
        ("7001", "m9", f"{day1} 06:00", "Creatinine", 2.4, None, None),
        ("7002", "n1", "2026-03-05 08:00", "Temp", 37.0, None, "C"),
    ]
    drugs = [
        ("7001", "d1", f"{day1} 02:30", f"{day1} 06:30", "Vancomycin", "IV", None, None),
        ("7001", "d2", "2026-03-03 18:30", "2026-03-04 11:30", "Vancomycin", "IV", None, None),
        ("7001", "d3", f"{day1} 02:00", f"{day1} 03:00", "Erythromycin", "ophthalmic", None, "antibiotic"),
        ("7002", "d4", "2026-03-05 09:00", "2026-03-05 10:00", "Aspirin", "PO", None, None),
    ]
    cultures = [
        ("7001", "c1", f"{day1} 05:00", "Blood", "Escherichia coli", "(+)"),
        ("7001", "c2", f"{day1} 05:30", "Blood", "Escherichia coli", "positive"),
        ("7002", "c3", "2026-03-05 09:00", "Urine", "", "No growth"),
    ]
    visits = [("7001", 1, f"{day0} 23:00", None), ("7002", 2, None, "2026-03-05"), ("7003", None, None, None)]
    return compute(spark, visits, measurements, drugs, cultures)


def test_full_encounter(full):
    row = full[0]["7001"]
    assert row.t0 == "23:00" and row.t0_source == "icu_admit_datetime"
    assert [row.sep1_v3___1, row.sep1_v3___2, row.sep1_v3___3, row.sep1_v3___4] == ["1", "0", "0", "1"]
    assert row.sep3_v3 == "Blood, Escherichia coli, (+)"
    assert row.sep4_v3 == "1" and "57.0h" in row.course_summary
    assert row.sep6_v3 == "3.7" and row.lactate_ref == "m5"
    assert row.sep7_v3 == "0, 4" and row.daily_sofa_map == {0: 0, 1: 4}
    assert row.sep_day_v3 == "1"
    assert (row.sep_dt_v3, row.sep_days, row.sep_time) == ("02:00", "1", "180")
    assert any("on day +1" in flag for flag in row.review_flags)


def test_sparse_encounter_stays_unknown(full):
    row = full[0]["7002"]
    assert row.t0_source == "earliest_same_day_event" and row.t0 == "08:00"
    assert row.sep1_v3___1 == "0" and row.sep1_v3___3 is None and row.sep1_v3___4 is None
    assert row.sep3_v3 == "NO" and row.sep4_v3 == "0" and row.sep6_v3 is None and row.sep_day_v3 is None
    empty = full[0]["7003"]
    assert empty.t0_source == "missing" and empty.t0 == "" and empty.sep3_v3 is None and empty.sep4_v3 is None
    assert empty.person_id == 0


def test_provenance(full):
    rows = {(r.vid, r.field_name): r for r in full[1].collect()}
    assert rows["7001", "sep1_v3___1"].source_ref == "m1"
    assert "38.61" in rows["7001", "sep1_v3___1"].evidence_quote
    assert rows["7001", "sep1_v3___3"].evidence_quote == "RR/PaCO2 normal (PaCO2 unmeasured)"
    assert rows["7001", "sep_day_v3"].evidence_quote.startswith("SOFA up by 4")
    assert rows["7002", "sep4_v3"].evidence_quote == "No systemic antibiotics in medication table"


def test_missing_calendar_day_is_no_baseline(spark):
    measurements = [
        ("1", "a", "2026-01-01 10:00", "creatinine", 1.0, None, None),
        ("1", "b", "2026-01-03 10:00", "creatinine", 4.0, None, None),
    ]
    drugs = [("1", "d", "2026-01-01 00:00", "2026-01-05 00:00", "cefepime", None, None, None)]
    rows, _ = compute(spark, [("1", 1, "2026-01-01 09:00", None)], measurements, drugs, [("1", "c", None, "", "", "")])
    assert rows["1"].sep7_v3 == "0, 3" and rows["1"].sep_day_v3 is None


def test_early_events_only_when_nothing_else(spark):
    measurements = [
        ("1", "a", "2026-01-01 10:00", "hr", 120.0, None, None),
        ("1", "b", "2026-01-09 10:00", "hr", 130.0, None, None),
        ("2", "c", "2026-01-01 10:00", "hr", 120.0, None, None),
    ]
    visits = [("1", 1, "2026-01-08 09:00", None), ("2", 1, "2026-01-08 09:00", None)]
    rows, _ = compute(spark, visits, measurements, [("9", "d", None, None, "x", None, None, None)],
                      [("9", "c", None, "", "", "")])
    assert rows["1"].sep_dt_v3 == "10:00" and rows["1"].sep_days == "1"
    assert rows["2"].sep_days == "0" and rows["2"].sep_time.startswith("-")
    assert any("before admission to the unit" in flag for flag in rows["2"].review_flags)


def test_vasopressor_days_and_vent(spark):
    measurements = [
        ("1", "a", "2026-01-01 10:00", "PaO2", 80.0, None, None),
        ("1", "b", "2026-01-01 10:00", "FiO2", 90.0, None, None),
        ("1", "c", "2026-01-01 10:00", "Ventilator", None, "mechanical", None),
    ]
    drugs = [("1", "d", "2026-01-01 08:00", "2026-01-03 08:00", "Norepinephrine", "IV", "0.2", None)]
    rows, _ = compute(spark, [("1", 1, "2026-01-01 09:00", None)], measurements, drugs, [("9", "c", None, "", "", "")])
    assert rows["1"].daily_sofa_map == {0: 8, 1: 4, 2: 4}


def test_hot_undated_visit_and_placeholder_end(spark):
    """Half of the hot visit's rows have no date; a drug runs to the year 9999."""
    visits = [("1", 1, "2026-01-08 09:00", None)]
    measurements = [("1", f"m{i}", None if i % 2 else f"2026-01-0{8 + i % 3 if 8 + i % 3 < 10 else 9} 10:00", "lactate", float(1 + i % 5), None, "mmol/L") for i in range(4000)]
    drugs = [("1", "d", "2026-01-08 10:00", "9999-12-31", "Norepinephrine", "IV", None, None)]
    rows, _ = compute(spark, visits, measurements, drugs, [("1", "c", None, "", "", "")])
    assert rows["1"].sep6_v3 == "5" and len(rows["1"].daily_sofa_map) < 10
