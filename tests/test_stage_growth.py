"""Stage views and signals of lines, dropped or counted early."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom import skew
from chartloom.functions import text
from chartloom.operators import abstraction, charts, facts

M = "visit_occurrence_id string, measurement_id string, measurement_datetime string, measurement_name string, value_as_number double, value_as_string string, unit string"
D = "visit_occurrence_id string, drug_exposure_id string, drug_start_datetime string, drug_end_datetime string, drug_name string, route string, dose_rate string, drug_class string"
C = "visit_occurrence_id string, culture_id string, collection_datetime string, source string, organism string, result string"
V = "visit_occurrence_id string, person_id long, icu_admit_datetime string, visit_start_date string"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _typed(spark, measurements, drugs, cultures, visits):
    return facts.chart_tables(*(spark.createDataFrame(rows, schema) for rows, schema in ((visits, V), (measurements, M), (drugs, D), (cultures, C))))


def test_stage_views_of_a_repeated_visit(spark):
    pieces = spark.createDataFrame(
        [("1", "stage2", 1, "[A]", "2026-01-02 00:00:00", None, "b"), ("1", "stage2", 1, "[A]", "2026-01-01 00:00:00", None, "a"),
         ("9", "stage2", 1, "[A]", "2026-01-01 00:00:00", None, "gone")],
        "vid string, stage string, section_order int, section string, t string, piece_id long, piece string",
    ).withColumn("piece_time", F.col("t").cast("timestamp_ntz")).drop("t")
    shown = charts.stage_views(pieces, spark.createDataFrame([("1",), ("1",), ("2",)], "vid string"))
    rows = sorted((r.vid, r.stage, r.part, r.view) for r in shown.collect())
    assert [r for r in rows if r[:2] == ("1", "stage2")] == [("1", "stage2", p, v) for p, v in ((1, "[A]"), (2, "a"), (3, "b")) for _ in range(2)]
    assert len(rows) == 6 + 4 + 3 and {r[3] for r in rows if r[0] == "2"} == {fixed.NO_DISCHARGE, fixed.NO_STAGE2, fixed.NO_STAGE3}
    # Texts met the list of visits, and pieces were read for titles, for sizes and for views.
    joins = [line for line in _plan(shown).splitlines() if "Join LeftOuter" in line]
    assert not joins


def test_only_lines_with_signals_meet_reference_times(spark):
    names = ["HR 118", "Lactate", "Temp", "Sodium", "Shock index", "no sepsis", "Urosepsis", "WBC 14"]
    measurements = [("1", f"m{k}", "2026-03-01 09:00", name, 38.5, None, "k") for k, name in enumerate(names)] + [("1", "m", None, "Fever", 1.0, None, None)]
    drugs = [("1", "d1", "2026-03-01 12:00", None, "Norepinephrine", "IV", "38.2", None), ("1", "d2", "2026-03-01 12:00", None, "Cefepime", "IV", None, None)]
    cultures = [("1", "c1", "2026-03-01 12:00", "Abscess", "Klebsiella", "(+)"), ("1", "c2", "2026-03-01 12:00", "Blood", "Bacteremia\nx", "(+)"),
                ("2", "c3", "2026-03-01 12:00", "Blood", "Klebsiella", "(+)")]
    t = _typed(spark, measurements, drugs, cultures, [("1", 1, "2026-03-01 08:00", None), ("2", 2, None, None)])
    tables = t.measurements, t.cultures, t.drugs, t.anchors
    every, some = charts.structured_lines(*tables), charts.structured_lines(*tables, abstraction.may_signal)
    assert some.count() < every.count()
    notes = charts.panel_notes(spark.createDataFrame([], "note_id string, visit_occurrence_id string, note_text string"), t.anchors)
    names = [*abstraction.SIGNALS, "lactate_said", "infection_line"]

    def signals(lines):
        pieces = abstraction.piece_signals(notes, lines).selectExpr("*", "size(quotes) AS n")
        anything = F.lit(False)
        for n in abstraction.SIGNALS:
            anything = anything | F.col(n)
        kept = pieces.filter(anything | (F.col("n") > 0) | F.col("lactate_said").isNotNull() | F.col("infection_line").isNotNull())
        return sorted(map(str, kept.select("vid", *names, "n").collect()))

    assert signals(every) == signals(some) and len(signals(some)) >= 6


# ------------------------------------------------------------------ views of all stages at once
N = "visit_occurrence_id string, note_id string, note_datetime string, note_title string, note_text string"
L = "vid string, section_order int, section string, line_time timestamp_ntz, line string"
TITLES = ("Discharge Summary", "H&P", "Progress")


def _notes():
    return [(v, str(k), f"2026-01-0{k % 4 + 1} 09:00" if k else None, TITLES[k % 3], f"text {k}") for v, n in (("1", 9), ("2", 2)) for k in range(n)]


def _lines():
    days = [dt.datetime(2026, 1, 1 + k % 5, k % 3) for k in range(12)] + [None]
    return [(v, s, f"[{s}]", d, f"line {k}") for v, sections in (("1", (1, 3)), ("3", (2,))) for s in sections for k, d in enumerate(days)]


def _expected(pieces, visits):
    """Views of the pieces, by sorting each of them."""
    far, absent = dt.datetime(9999, 12, 31), dict(zip(charts.STAGES, (fixed.NO_DISCHARGE, fixed.NO_STAGE2, fixed.NO_STAGE3)))
    rows = []
    for vid, stage in itertools.product(visits, charts.STAGES):
        own = [r for r in pieces if (r.vid, r.stage) == (vid, stage)]
        parts = [(r.section_order, 1, r.piece_time or far, r.piece_id or 0, r.piece) for r in own]
        parts += {(r.section_order, 0, far, 0, r.section) for r in own if r.section}
        rows += [(vid, stage, k, p[-1]) for k, p in enumerate(sorted(parts) or [(absent[stage],)], 1)]
    return sorted(rows)


@pytest.mark.parametrize("crowd", [50_000, 20, 2])
def test_views_of_all_stages_from_one_row_a_piece(spark, monkeypatch, crowd):
    monkeypatch.setattr(skew, "CROWD", crowd)
    visits = ["1", "1", "2", "3", "4"]
    anchors = spark.createDataFrame([(v, dt.datetime(2026, 1, 2, 8)) for v in sorted(set(visits))], "vid string, t0_time timestamp_ntz")
    notes, lines = spark.createDataFrame(_notes(), N), spark.createDataFrame(_lines(), L)
    ids = notes.select("visit_occurrence_id").unionAll(lines.select("vid"))
    crowded = charts.crowded_visits(ids, *[ids.limit(0)] * 3)
    assert (0 if crowded.found is None else crowded.found.count()) == {50_000: 0, 20: 1, 2: 2}[crowd]
    panels = charts.panel_notes(notes, anchors, crowded=crowded)
    listed = spark.createDataFrame([(v,) for v in visits], "vid string")
    each = charts.stage_pieces(charts.panel_notes(notes, anchors), lines)
    expected = _expected(each.collect(), visits)
    for pieces, known in ((charts.stage_pieces(panels, lines, per_stage=False), crowded), (each, crowded), (each, None)):
        assert sorted(map(tuple, charts.stage_views(pieces, listed, known).collect())) == expected


def test_lines_are_dealt_and_ordered_once(spark):
    notes = spark.createDataFrame(_notes(), N)
    t = _typed(spark, [("1", "m", "2026-03-01 09:00", "HR", 1.0, None, "k")], [("1", "d", "2026-03-01 12:00", None, "Cefepime", "IV", None, None)],
               [("1", "c", "2026-03-01 12:00", "Blood", "Klebsiella", "(+)")], [("1", 1, "2026-03-01 08:00", None)])
    crowded = charts.crowded_visits(notes, *[notes.limit(0)] * 3)
    lines = charts.structured_lines(t.measurements, t.cultures, t.drugs, t.anchors, crowded=crowded)
    pieces = charts.stage_pieces(charts.panel_notes(notes, t.anchors, crowded=crowded), lines, per_stage=False)
    shown = charts.stage_views(pieces, t.anchors, crowded).groupBy("vid", "stage").count()
    plan = shown._jdf.queryExecution().executedPlan().toString()
    # Both sides of four joins are dealt by visit, and so is the list of visits; nothing is dealt again, and one sort serves all stages.
    assert plan.count("Exchange hashpartitioning(vid") == plan.count("Exchange") == 9
    assert plan.count(" Sort [") == 1


def test_texts_of_named_notes_are_read_once(spark):
    anchors = spark.createDataFrame([("1", None), ("2", None)], "vid string, t0_time timestamp_ntz")
    named = charts.panel_notes(spark.createDataFrame(_notes(), N), anchors)
    assert _plan(named).count("LogicalRDD [visit_occurrence_id") == 1 and "Window" not in _plan(named)
    # A note without an id takes its place among the notes of its visit, and that of another visit changes nothing.
    some = charts.panel_notes(spark.createDataFrame([*_notes(), ("2", None, "2026-01-09 09:00", "H&P", "nameless")], N), anchors)
    ids = {(r.vid, r.note_text): r.note_id for r in some.collect()}
    assert ids.pop(("2", "nameless")) == 2
    assert ids == {(r.vid, r.note_text): r.note_id for r in named.collect()}


def test_dates_are_seen_by_what_they_start_with(spark):
    cases = ["on 2024-01-02", "x2024-01-02", "1/2/24 and 12/31/1999", "13/1/24", "Mar 3rd, 2024", "MAY 1", "\u017fep 3", "Augu\u017ft 9", "seen Dec. 31st 1999", "Marc 3",
             "\u0662\u0660\u0662\u0664-\u0660\u0661-\u0660\u0662", "a2/3/24"]
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    plain = F.col("t")
    for shape in fixed.DATE_SHAPES:
        plain = F.regexp_replace(plain, text.UNICODE + shape, fixed.DATE_REDACTED)
    found = rows.select(text.scrub_dates(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found] and sum("REDACTED" in r.a for r in found) >= 7
