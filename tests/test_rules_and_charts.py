import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from chartloom.functions import text, values
from chartloom.operators import charts, rules

NOTES = "note_id long, visit_occurrence_id double, note_datetime string, note_title string, note_text string"
VISITS = "visit_occurrence_id string, person_id long, visit_start_date string, visit_end_date string"


def decide(spark, lines, condition):
    rows = [(i, float(100 + i), None, "n", line) for i, line in enumerate(lines)]
    visits = [(str(100 + i), 1, "a", "b") for i in range(len(lines))]
    out = rules.rule_adjudicate(spark.createDataFrame(rows, NOTES), spark.createDataFrame(visits, VISITS), condition, "t")
    return [r for r in out.orderBy("visit_occurrence_id").collect()]


def test_sepsis_negation(spark):
    rows = decide(spark, ["septic shock today", "no evidence of sepsis", "r/o septic emboli", "Urosepsis, improving",
                          "no sign of sepsis. " + "x" * 80 + " bacteremia"], "Sepsis / Septic Shock")
    assert [r.condition_present for r in rows] == [True, False, False, True, True]
    assert rows[4].key_evidence[0].evidence_quote.startswith("...") and rows[4].key_evidence[0].evidence_quote.endswith("bacteremia")


def test_only_the_first_occurrence_of_a_pattern_counts(spark):
    far = "no sepsis " + "x" * 100 + " sepsis"
    assert not decide(spark, [far], "sepsis")[0].condition_present


def test_stroke_ards_aki(spark):
    rows = decide(spark, ["acute ischemic stroke on CT", "history of prior stroke", "ischemic cardiomyopathy and stroke", "CVA"], "Acute Ischemic Stroke")
    assert [r.condition_present for r in rows] == [True, False, False, True]
    assert rows[0].confidence_score == 0.95 and rows[1].confidence_score == 0.98
    assert [r.condition_present for r in decide(spark, ["ARDS", "no respiratory distress"], "ARDS")] == [True, False]
    assert [r.condition_present for r in decide(spark, ["AKI on CKD", "no AKI", "oliguria"], "renal injury")] == [True, False, True]


def test_custom_condition(spark):
    rows = decide(spark, ["large pulmonary  embolism seen", "denies pulmonary embolism", "well"], "Pulmonary Embolism (PE)")
    assert [r.condition_present for r in rows] == [True, False, False]
    assert rows[0].primary_criteria_met == ["Findings in the notes fit Pulmonary Embolism (PE) (pulmonary  embolism)"]
    assert decide(spark, ["anything"], "of / the")[0].confidence_score == 0.90


def test_first_three_in_note_order_and_dirty_keys(spark):
    notes = [(i, 5.0, f"2026-01-{10 - i:02d} 10:00", "n", f"sepsis {i}") for i in range(6)] + [(9, None, None, "n", "sepsis")]
    visits = [("5", 1, "a", "b"), ("5.0x", 1, "a", "b"), (None, 1, "a", "b")]
    out = rules.rule_adjudicate(spark.createDataFrame(notes, NOTES), spark.createDataFrame(visits, VISITS), "sepsis", "t").collect()
    assert len(out) == 1 and [e.note_id for e in out[0].key_evidence] == [5, 4, 3]
    index = charts.visit_index(spark.createDataFrame(notes, NOTES), spark.createDataFrame(visits, VISITS)).collect()
    assert [(r.visit_occurrence_id, r.note_count) for r in index] == [(5, 6)]


def test_chart_limits_and_hot_visit(spark):
    notes = spark.range(5000).select(
        F.col("id").alias("note_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("visit_occurrence_id"),
        F.lit(None).cast("string").alias("note_datetime"), F.lit("n").alias("note_title"), F.repeat(F.lit("ab"), 50).alias("note_text"))
    visits = spark.createDataFrame([("1", 1, "a", "b")], VISITS)
    whole = charts.load_charts(notes, visits).first()
    assert whole.note_count == 1668 and whole.notes_formatted_text.count("ab" * 50) == 1668
    chart = charts.load_charts(notes, visits, max_notes=4, max_chars=10).first()
    assert chart.notes_dropped == 1664
    assert chart.note_count == 4
    assert re.findall(r"Note ID: (\d+)", chart.notes_formatted_text) == ["0", "1", "3", "6"]
    assert chart.notes_formatted_text.count("ababababab\n") == 4 and "ab" * 6 not in chart.notes_formatted_text


def test_stage_views(spark):
    anchors = spark.createDataFrame([("1", dt.datetime(2026, 1, 2, 8)), ("2", None)], "vid string, t0_time timestamp_ntz")
    notes = spark.createDataFrame([
        ("1", None, "2026-01-03 09:00", "Discharge Summary", "seen 2026-01-03"), ("1", "7", "2026-01-01 09:00", "H&P", "first")],
        "visit_occurrence_id string, note_id string, note_datetime string, note_title string, note_text string")
    panels = charts.panel_notes(notes, anchors)
    lines = spark.createDataFrame([("1", 1, "[Structured Vital Signs & Labs]", dt.datetime(2026, 1, 2, 9), "- hr: 90")],
                                  "vid string, section_order int, section string, line_time timestamp_ntz, line string")
    pieces = charts.stage_pieces(panels, lines)
    rows = sorted(charts.stage_views(pieces, anchors).collect(), key=lambda r: r.part)
    views = {k: "\n".join(r.view for r in rows if (r.vid, r.stage) == k) for k in {(r.vid, r.stage) for r in rows}}
    assert views["2", "stage1"] == "[NO_DISCHARGE_SUMMARY]" and views["2", "stage3"] == "[NO_CLINICAL_DATA]"
    assert "Day +1 09:00" in views["1", "stage1"] and "[DATE REDACTED]" in views["1", "stage1"]
    assert views["1", "stage3"].index("Day -1") < views["1", "stage3"].index("Day +1") < views["1", "stage3"].index("- hr: 90")
    assert [r.part for r in rows if (r.vid, r.stage) == ("1", "stage3")] == [1, 2, 3, 4]
    assert rows[0].part == 1 and "[Structured Vital Signs & Labs]" in views["1", "stage3"]


# ------------------------------------------------------------------ text functions against plain Python
def brute_highlight(body, quotes, keyword):
    spans = []
    for q in quotes:
        q = q.strip()
        at = body.lower().find(q.lower())
        if len(q) < 6:
            continue
        if at >= 0:
            spans.append((at, at + len(q), "quote"))
        elif len(q.split()) >= 3:
            m = re.search(r"\s+".join(re.escape(w) for w in q.split()), body, re.I)
            if m:
                spans.append((m.start(), m.end(), "quote"))
    if len(keyword.strip()) >= 2:
        spans += [(m.start(), m.end(), "keyword") for m in re.finditer(re.escape(keyword.strip()), body, re.I)]
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], -(s[1] - s[0]))):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


@pytest.mark.parametrize("body, quotes, keyword", [
    ("The patient had septic shock; the shock resolved.", ["septic shock", "patient  had septic"], "the"),
    ("a.b a.b (x) a.b", ["(x) a.b", "tiny"], "a.b"),
    ("no\nnewline here at all", ["newline   here at"], "zz"),
    ("Mixed CASE words mixed case", ["mixed case", None], " case "),
])
def test_highlight(spark, body, quotes, keyword):
    df = spark.createDataFrame([(body, quotes, keyword)], "b string, q array<string>, k string")
    got = df.select(text.highlight_spans(F.col("b"), F.col("q"), F.col("k")).alias("s")).first().s
    assert [tuple(x) for x in got] == brute_highlight(body, [q for q in quotes if q], keyword)


def test_grounding(spark):
    chart = "Pt had  SEPTIC shock on arrival; lactate 4.2 given fluids"
    cases = {"septic shock on arrival": True, '"Septic   shock".': True, "...lactate 4.2...": True, "abc": False, "": False,
             "septic fluids arrival unknown": True, "totally made up words": False}
    df = spark.createDataFrame([(q, chart) for q in cases], "q string, c string")
    rows = df.select("q", text.quote_grounded(F.col("q"), F.col("c")).alias("g")).collect()
    assert {r.q: r.g for r in rows} == cases


def test_values(spark):
    df = spark.createDataFrame([("23:59", "12:60", "lactate -3.5 then 4", "1, 2; x, 7.5", "Blood: E. coli (+)")], "a string, b string, c string, d string, e string")
    row = df.select(
        values.clock_minutes(F.col("a")), values.clock_minutes(F.col("b")), values.first_number(F.col("c")),
        values.number_list(F.col("d")), values.organism_tokens(F.col("e")), values.confounder_codes(F.array(F.lit("9"), F.lit(" 2 "), F.lit("4"))),
        values.confounder_codes(F.array(F.lit("4"), F.lit("9"))), text.short_number(F.lit(3.70)), text.short_number(F.lit(1234567.0)),
        values.criteria_key(F.lit("Acute Ischemic Stroke")), text.scrub_dates(F.lit("on March 3rd, 2024 and 1/2/24"))).first()
    assert list(row) == [1439, None, -3.5, [1.0, 2.0, 7.5], ["coli"], ["2"], ["9"], "3.7", "1234567", "stroke",
                         "on [DATE REDACTED] and [DATE REDACTED]"]


def test_several_conditions_in_one_pass(spark):
    lines = ["septic shock, acute ischemic stroke\nAKI on CKD", "no evidence of sepsis\nARDS", "  ", "history of prior stroke", "large pulmonary embolism\nurosepsis"]
    notes = spark.createDataFrame([(i, float(100 + i), None, "n", line) for i, line in enumerate(lines)], NOTES)
    visits = spark.createDataFrame([(str(100 + i), i, "a", "b") for i in range(len(lines) + 1)], VISITS)
    conditions = ["Sepsis / Septic Shock", "Acute Ischemic Stroke", "ARDS", "AKI", "sepsis again", "Pulmonary Embolism (PE)", "of / the"]
    got = rules.rule_adjudicate_all(notes, visits, conditions, "t")
    for condition in conditions:
        alone = rules.rule_adjudicate(notes, visits, condition, "t")
        one = got.filter(F.col("target_condition") == condition).select(*alone.columns)
        assert one.schema.simpleString() == alone.schema.simpleString()
        assert sorted(one.collect(), key=str) == sorted(alone.collect(), key=str)
    assert got.count() == len(conditions) * 6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("note_text") and len(re.findall(r"LogicalRDD|LocalRelation", plan)) == 2
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            rules.rule_adjudicate_all(notes, visits, wrong, "t")


def test_terms_are_returned_on_demand(spark):
    notes = spark.createDataFrame([(1, 1.0, None, "n", "pulmonary embolism, then embolism")], NOTES)
    visits = spark.createDataFrame([("1", 1, "a", "b"), ("2", 1, "a", "b")], VISITS)
    out = rules.rule_adjudicate(notes, visits, "Pulmonary Embolism", "t", keep_terms=True)
    assert {r.visit_occurrence_id: r.terms for r in out.collect()} == {1: ["pulmonary embolism"], 2: []}


def test_a_keyword_may_hold_the_end_of_quoting(spark):
    df = spark.createDataFrame([(r"a\Eb c a\eb (x)", r"a\Eb"), ("1+1 (x) [y]", "+1 (x) [")], "body string, key string")
    spans = text.highlight_spans(F.col("body"), F.array().cast("array<string>"), F.col("key"))
    assert [[(s.start, s.end) for s in r[0]] for r in df.select(spans).collect()] == [[(0, 4), (7, 11)], [(1, 9)]]


def test_a_text_of_many_keywords_is_lowered_and_cut_once(spark):
    body = "The other text, then THE end; " * 40
    df = spark.createDataFrame([(body, ["other  text", "nowhere at all"], "the"), (None, ["other text"], "the")], "b string, q array<string>, k string")
    out = df.select(text.highlight_spans(F.col("b"), F.col("q"), F.col("k")).alias("s"))
    got = out.collect()
    assert [tuple(x) for x in got[0].s] == brute_highlight(body, ["other  text", "nowhere at all"], "the") and got[1].s == []
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(b#") == 1
