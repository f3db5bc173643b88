"""Facts that read no row more often than they need."""

from pyspark.sql import functions as F

from chartloom.functions import values
from chartloom.operators import facts

M = "visit_occurrence_id string, measurement_id string, measurement_datetime string, measurement_name string, value_as_number double, value_as_string string, unit string"
D = "visit_occurrence_id string, drug_exposure_id string, drug_start_datetime string, drug_end_datetime string, drug_name string, route string, dose_rate string, drug_class string"
C = "visit_occurrence_id string, culture_id string, collection_datetime string, source string, organism string, result string"
V = "visit_occurrence_id string, person_id long, icu_admit_datetime string, visit_start_date string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _typed(spark, measurements, drugs, cultures, visits):
    return facts.chart_tables(*(spark.createDataFrame(rows, schema) for rows, schema in ((visits, V), (measurements, M), (drugs, D), (cultures, C))))


def test_dated_rows_only_where_visits_do_not_tell(spark):
    bad = spark.createDataFrame([("1", "m1", "Temp", 39.0)], "visit_occurrence_id string, measurement_id string, measurement_name string, value_as_number double")
    bad = bad.withColumn("measurement_datetime", F.raise_error(F.lit("a dated row was read")).cast("timestamp_ntz"))
    visits = spark.createDataFrame([("1", 1, "2026-03-01 08:00", None)], V)
    empty = spark.createDataFrame([], D), spark.createDataFrame([], C)
    assert facts.chart_tables(visits, bad, *empty).anchors.collect()[0].t0_source == "icu_admit_datetime"
    t = _typed(spark, [("2", "m", "2026-03-04 07:00", "HR", 80.0, None, None), ("3", "m", "2026-03-02 07:00", "HR", 80.0, None, None)], [], [],
               [("1", 1, "2026-03-01 08:00", None), ("2", 2, None, None), ("3", 3, None, "2026-03-02"), ("4", 4, None, "2026-03-03")])
    assert {r.vid: r.t0_source for r in t.anchors.collect()} == {
        "1": "icu_admit_datetime", "2": "earliest_event", "3": "earliest_same_day_event", "4": "visit_start_date_midnight"}


def test_rise_inside_a_long_span(spark):
    def rise(*drugs):
        t = _typed(spark, [("1", "p0", "2026-03-05 09:00", "Platelets", 200.0, None, None), ("1", "p1", "2026-03-06 09:00", "Platelets", 40.0, None, None)],
                   [("1", f"d{k}", start, end, "Cefepime", "IV", None, None) for k, (start, end) in enumerate(drugs)], [],
                   [("1", 1, "2026-03-05 08:00", None)])
        found = facts.structured_facts(t.anchors, t.measurements, t.drugs, t.cultures)
        # A day of a rise was repeated for each of 24 block levels.
        assert "posexplode" not in _plan(found)
        return found.collect()[0].sep_day_v3

    assert rise(("2026-03-01 08:00", "2026-03-09 08:00"), ("2026-03-02 08:00", "2026-03-02 09:00")) == "1"
    assert rise(("2026-03-01 08:00", "2026-03-05 23:00"), ("2026-03-07 08:00", "2026-03-09 09:00")) is None
    assert rise(("2026-03-06 20:00", None)) == "1" and rise() is None


def test_visit_keys(spark):
    rows = [("7",), (" 7 ",), ("7.0",), ("007",), ("-7",), ("7.5",), ("a7",), ("",), ("99999999999999999999",), ("+7",), (None,), ("7 ",)]
    got = [r[0] for r in spark.createDataFrame(rows, "k string").select(values.visit_key(F.col("k"))).collect()]
    assert got == ["7", "7", "7", "007", "-7", "7.5", "a7", "", "99999999999999999999", "+7", None, "7"]
