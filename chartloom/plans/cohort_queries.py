"""Queries over the staged abstraction: its stage texts, gates and three outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions.text import text_digest
from chartloom.operators import abstraction, charts, facts, rules
from chartloom.plans import cohort, sql, views
from chartloom.plans.registry import register
from chartloom.plans.table_queries import ABNORMAL_SQL, DAYS_ORIGIN, FACTS_SQL, RISE_SQL, SCORES_SQL, T0, episodes_sql
from chartloom.session import reliable_checkpoint
from chartloom.skew import Crowd

RUN_TS = "2026-01-31T00:00:00+00:00"
EARLY = f"TIMESTAMP '{T0}' - INTERVAL 48 HOUR"


def _cohort_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "notes": views.cohort_notes(spark, folder), "visits": views.user_visits(spark, folder),
        "measurements": views.measurements(spark, folder), "drugs": views.order_drugs(spark, folder),
        "cultures": views.part_cultures(spark, folder),
    }


def _abstracted(spark: SparkSession, folder: str) -> abstraction.Abstraction:
    return cohort.abstract_cohort(**_cohort_tables(spark, folder), run_ts=RUN_TS, institution="7")


# ------------------------------------------------------------------ signals in SQL
def _said(pattern: str, text: str = "low") -> str:
    """Whether a text holds the pattern, word edges of all languages included."""
    head = rf"(?:^|{sql.EDGE})" if pattern.startswith(r"\b") else ""
    tail = rf"(?:{sql.EDGE}|$)" if pattern.endswith(r"\b") else ""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return f"regexp_matches({text}, '{head}(?:{inner}){tail}')"


def _digits(number: str, places: int) -> str:
    """A double with decimals, halves rounded up as written."""
    return f"CAST(CAST(round(CAST(CAST({number} AS VARCHAR) AS DECIMAL(28, 9)), {places}) AS DECIMAL(28, {places})) AS VARCHAR)"


def _short(number: str) -> str:
    """Six significant digits without trailing zeros."""
    cases = " ".join(f"WHEN abs({number}) >= {low} THEN {_digits(number, places)}" for places, low in (
        (0, 1e5), (1, 1e4), (2, 1e3), (3, 1e2), (4, 1e1), (5, 1.0), (6, 0.1), (7, 0.01)))
    text = f"CASE {cases} WHEN {number} IS NOT NULL THEN {_digits(number, 9)} END"
    return rf"regexp_replace(regexp_replace({text}, '(\.\d*?)0+$', '\1'), '\.$', '')"


_POSITIVE_CULTURE = "result <> 'negative' AND organism NOT IN ('', 'No growth')"
_COURSE_ROWS = f"SELECT vid, s, e, flag = 'R' AS trough, ref FROM ({views.DRUGS_SQL}) WHERE flag IN ('R', 'A')"
_FIELDS = {"temp": ("sep1_v3___1", "Temp(C)", 2), "hr": ("sep1_v3___2", "HR", 2), "rr": ("sep1_v3___3", "RR", 1),
           "wbc": ("sep1_v3___4", "WBC/Bands", 1), "lactate": ("sep6_v3", "lactate", 2)}
_RANKED = {kind: facts.EVENT_RANK[kind] for kind in _FIELDS}
_WHY = " ".join(f"WHEN '{k}' THEN '{field}:{name}=' || {_digits('level', places)}" for k, (field, name, places) in _FIELDS.items())
_CRITERIA = tuple(facts.CRITERIA)


def _stage_quotes(name: str, where: str) -> str:
    return f"""{name} AS (SELECT vid, note_id, quote, place FROM (SELECT *, row_number() OVER (PARTITION BY vid
      ORDER BY note_datetime, note_id, line_no) AS place FROM ev WHERE {where}) WHERE place <= 3)"""


# One row per visit, "decided", and the quotes and facts behind it. The walk over intervals is recursive.
COHORT_SQL = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT CAST(visit_occurrence_id AS VARCHAR) AS vid, *, lower(note_text) AS low FROM ({views.COHORT_NOTES_SQL})),
  ev AS MATERIALIZED (SELECT CAST(visit_occurrence_id AS VARCHAR) AS vid, r.*, note_id % 5 AS kind FROM ({sql.rule_lines(views.COHORT_NOTES_SQL, rules.RULES["sepsis"])}) r),
  {_stage_quotes("q1", "kind = 0")}, {_stage_quotes("q2", "kind = 1")}, {_stage_quotes("q3", "true")},
  lactates AS (SELECT vid, max(CAST(x AS DOUBLE)) AS lactate_said FROM (SELECT vid, unnest(regexp_extract_all(low, '{abstraction.LACTATE_TEXT}', 1)) AS x FROM n) GROUP BY 1),
  spoken AS (SELECT vid, bool_or(panel = 'discharge_summary') AS has_discharge, bool_or(panel = 'hp') AS has_hp,
      bool_or(panel IN ('hp', 'progress_consult', 'procedure_operative')) AS has_general,
      bool_or(panel = 'discharge_summary' AND {_said(abstraction.AMBIGUOUS)}) AS ambiguous,
      {', '.join(f"bool_or({_said(p)}) AS {name}" for name, p in abstraction.SIGNALS.items() if name != 'ambiguous')} FROM n GROUP BY 1),
  warm AS (SELECT vid, bool_or({_said(abstraction.FEVER, "lower(name || ': ' || CAST(raw AS VARCHAR) || ' k')")}) AS warm_line FROM ({views.MEASUREMENTS_SQL}) GROUP BY 1),
  infected AS (SELECT vid, note_id AS infection_note, substr(line, 1, 180) AS infection_line FROM (SELECT *, row_number() OVER (PARTITION BY vid
      ORDER BY note_datetime, note_id, line_no) AS place FROM (SELECT vid, note_id, note_datetime, regexp_replace(unnest(string_split(note_text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line,
        generate_subscripts(string_split(note_text, chr(10)), 1) AS line_no FROM n) WHERE {_said(abstraction.INFECTION, "lower(line)")}) WHERE place = 1),
  facts AS MATERIALIZED ({FACTS_SQL}),
  top AS (SELECT vid, max(score) AS top_score, max(CASE WHEN day = 0 THEN score END) AS day0, max(CASE WHEN day = -1 THEN score END) AS day_before FROM ({SCORES_SQL}) GROUP BY 1),
  rise AS (SELECT vid, min(day) AS rise_day, arg_min(score, day) AS rise_score, arg_min(previous, day) AS rise_previous FROM ({RISE_SQL}) GROUP BY 1),
  levels AS MATERIALIZED (SELECT *, {ABNORMAL_SQL} AS hit FROM ({views.LEVELS_SQL})),
  courses AS MATERIALIZED (SELECT vid, s, (epoch(e) - epoch(s)) / 3600.0 AS hours, ref FROM ({episodes_sql(_COURSE_ROWS)})),
  long AS (SELECT vid, s, hours, ref FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY s, hours, ref) AS place FROM courses WHERE hours > 24) WHERE place = 1),
  course AS (SELECT vid, coalesce(long.ref, any_ref, 'med_rows') AS course_ref, CASE WHEN any_ref IS NULL THEN 'No systemic antibiotics in medication table'
      WHEN long.ref IS NULL THEN 'Antibiotic course <= 24h' ELSE 'Merged antibiotic course ' || {_digits('long.hours', 1)} || 'h (>24h)' END AS course_summary
    FROM (SELECT DISTINCT vid FROM ({views.DRUGS_SQL})) LEFT JOIN (SELECT vid, arg_min(ref, (s, hours, ref)) AS any_ref FROM courses GROUP BY 1) USING (vid) LEFT JOIN long USING (vid)),
  signs AS (SELECT vid, moment, CASE analyte {' '.join(f"WHEN '{k}' THEN {r}" for k, r in _RANKED.items())} END AS rank, event_id AS place, CASE analyte {_WHY} END AS why FROM levels WHERE hit
    UNION ALL SELECT vid, moment, 7, 0, 'sep3_v3:' || source || ':' || organism FROM ({views.CULTURES_SQL}) WHERE {_POSITIVE_CULTURE}
    UNION ALL SELECT vid, s, 8, 0, 'sep4_v3:abx_start(' || {_digits('hours', 1)} || 'h)' FROM long),
  onset AS (SELECT vid, moment AS onset, why, date_diff('day', DATE '{DAYS_ORIGIN}', CAST(moment AS DATE)) AS onset_day FROM (SELECT *, row_number() OVER (PARTITION BY vid
      ORDER BY moment < {EARLY}, moment, rank, place, why) AS r FROM signs) WHERE r = 1),
  known AS (SELECT f.*, top_score, day0, day_before, rise_day, rise_score, rise_previous, why, onset_day, course_ref, course_summary, {_short('lactate')} AS sep6_v3,
      coalesce(lactate >= 2, false) OR coalesce(top_score >= 2, false) AS organ, coalesce(sep4_v3 = '1', false) OR coalesce(sep3_v3 <> 'NO', false) AS infection,
      {' + '.join(f"CASE WHEN {c} = '1' THEN 1 ELSE 0 END" for c in _CRITERIA)} AS sirs,
      coalesce(has_discharge, false) AS has_discharge, coalesce(has_hp, false) AS has_hp, coalesce(has_general, false) AS has_general, ambiguous, surgery, vasoplegia, trauma,
      coalesce(shock, false) AS shock, coalesce(said_temp, false) OR coalesce(warm_line, false) AS said_temp, coalesce(said_hr, false) AS said_hr,
      coalesce(said_breath, false) AS said_breath, coalesce(said_wbc, false) AS said_wbc, lactate_said, infection_line, infection_note,
      f.vid IN (SELECT vid FROM q1) AS present1, f.vid IN (SELECT vid FROM q2) AS present2, f.vid IN (SELECT vid FROM q3) AS present3
    FROM facts f LEFT JOIN top USING (vid) LEFT JOIN rise USING (vid) LEFT JOIN onset USING (vid) LEFT JOIN course USING (vid) LEFT JOIN spoken USING (vid)
      LEFT JOIN warm USING (vid) LEFT JOIN lactates USING (vid) LEFT JOIN infected USING (vid)),
  answered AS (SELECT *, CASE WHEN NOT has_discharge THEN '3' WHEN present1 THEN '1' WHEN ambiguous THEN '3' ELSE '2' END AS gate,
      CASE WHEN present2 OR (infection AND (organ OR sirs >= 2)) THEN '1' ELSE '2' END AS follow,
      organ OR sep_day_v3 IS NOT NULL AS organ3, present3 OR infection AS infection3 FROM known),
  weighed AS (SELECT *, gate = '3' AS asked2, gate = '1' OR (gate = '3' AND follow = '1') AS opened,
      CASE WHEN present3 AND (organ3 OR shock) THEN 'CONFIRMED_POSITIVE' WHEN infection3 AND organ3 THEN 'SUSPECTED_PROBABLE' WHEN present3 THEN 'SUSPECTED_PROBABLE' ELSE 'INDETERMINATE_INSUFFICIENT_DATA' END AS status3,
      CASE WHEN present3 AND (organ3 OR shock) THEN 0.94 WHEN infection3 AND organ3 THEN 0.78 WHEN present3 THEN 0.72 ELSE 0.35 END AS score3,
      coalesce({', '.join((*_CRITERIA, 'sep3_v3', 'sep4_v3', 'sep6_v3', 'sep7_v3', 'sep_day_v3', 'sep_dt_v3'))}) IS NOT NULL AS sourced FROM answered),
  decided AS MATERIALIZED (SELECT *, opened AND status3 <> 'INDETERMINATE_INSUFFICIENT_DATA' AND NOT present3 AND infection_line IS NULL AND NOT sourced AS held FROM weighed),
  bare AS (SELECT *, trim(regexp_replace(trim(regexp_replace(quote, '^\\.\\.\\.[^\\[]*?\\]\\.?\\s*', '')), '\\s*\\[DATE RED[^\\]]*\\.\\.\\.$', '')) AS b FROM q3),
  cited AS MATERIALIZED (SELECT vid, note_id, place, CASE WHEN length(b) >= 8 THEN b ELSE quote END AS quote FROM bare
    UNION ALL SELECT vid, infection_note, 1, infection_line FROM decided WHERE NOT present3 AND infection_line IS NOT NULL),
  told AS (SELECT vid, substr(string_agg(clean, '; ' ORDER BY place), 1, 350) AS evidence_text FROM (SELECT vid, {views.scrubbed_sql('quote')} AS clean, min(place) AS place FROM cited GROUP BY 1, 2) GROUP BY 1)"""

_SAID_COLUMNS = dict(zip(_CRITERIA, ("said_temp", "said_hr", "said_breath", "said_wbc"), strict=True))
_COURSE_OF = {
    "record_id": "vid", "institution_v3": "'7'", "vid": "vid", "t0": "'12:00'", "sepsis_ync_v3": "gate",
    "sepsis_uncertain_v3": "CASE WHEN asked2 THEN follow ELSE '' END", "concept_1_v3___1": "CASE WHEN gate = '1' THEN '1' ELSE '0' END",
    **{f"concept_1_v3___{n}": "'0'" for n in range(2, 11)},
}
_WHEN_OPEN = {
    **{c: f"coalesce({c}, CASE WHEN {said} THEN '1' END)" for c, said in _SAID_COLUMNS.items()},
    "sep5_v3": views.scrubbed_sql("evidence_text"), "sep6_v3": f"coalesce(sep6_v3, {_short('lactate_said')})",
    **{c: c for c in ("sep3_v3", "sep4_v3", "sep7_v3", "sep_day_v3", "sep_dt_v3", "sep_days", "sep_time")},
    **{f"sep_surg_v3___{code}": f"CASE WHEN {name} THEN '1' ELSE '0' END" for code, name in (("1", "surgery"), ("2", "vasoplegia"), ("3", "trauma"))},
    "sep_surg_v3___4": "CASE WHEN coalesce(surgery OR vasoplegia OR trauma, false) OR NOT has_general THEN '0' ELSE '1' END",
    "sep_surg_v3___9": "CASE WHEN coalesce(surgery OR vasoplegia OR trauma, false) OR has_general THEN '0' ELSE '1' END",
}


def _survey_value(name: str) -> str:
    if name in _COURSE_OF:
        return f"{_COURSE_OF[name]} AS {name}"
    return f"CASE WHEN opened THEN coalesce({_WHEN_OPEN[name]}, '') ELSE '' END AS {name}" if name in _WHEN_OPEN else f"'' AS {name}"


@register(f"""{COHORT_SQL} SELECT {', '.join(_survey_value(n) for n in fixed.SURVEY_COLUMNS)} FROM decided LEFT JOIN told USING (vid)""")
def abstract_survey(spark: SparkSession, folder: str) -> DataFrame:
    """Survey rows of the whole staged abstraction."""
    return _abstracted(spark, folder).survey


_FLAGS = (
    "CASE WHEN rise_score - rise_previous = 2 THEN 'SOFA went up by two on day +' || rise_day || ' (' || rise_previous || ' to ' || rise_score"
    " || '): enough for a limit of two or more, not for one of more than two.' END",
    "CASE WHEN rise_day IS NULL AND day0 >= 2 AND day_before IS NULL THEN 'SOFA is ' || day0 || ' on day +0 and unknown on day -1; sep_day_v3 cannot be told.' END",
    "CASE WHEN onset_day < 0 THEN 'First sign (' || why || ') lies ' || abs(onset_day) || ' day(s) before admission to the unit; sep_days is set to 0.' END",
    "CASE WHEN onset_day > 0 THEN 'Onset is on day +' || onset_day || ', ' || sep_time || ' minutes after the reference time (clock times alone would not show the days between).' END",
    *(f"CASE WHEN opened AND {c} IS NULL AND NOT {said} THEN '{c}: neither tables nor notes tell; no value entered.' END" for c, said in _SAID_COLUMNS.items()),
    "CASE WHEN opened AND sep4_v3 IS NULL THEN 'sep4_v3: a course over 24 hours is not shown; no value entered.' END",
    "CASE WHEN held THEN 'Neither a quote found in the chart nor a table row backs this; set to INDETERMINATE.' END",
)


@register(f"""{COHORT_SQL} SELECT CAST(vid AS BIGINT) AS person_id, CAST(vid AS BIGINT) AS visit_occurrence_id, vid AS record_id, vid, '7' AS institution_v3, phenotype_status,
    phenotype_status IN ('CONFIRMED_POSITIVE', 'SUSPECTED_PROBABLE') AS condition_present, confidence_score, clinical_rationale, inference_backend, review_flags
  FROM (SELECT vid, CASE WHEN held THEN 'INDETERMINATE_INSUFFICIENT_DATA' WHEN opened THEN status3 ELSE 'CONFIRMED_NEGATIVE' END AS phenotype_status,
    CAST(CASE WHEN held THEN 0.0 WHEN opened THEN score3 WHEN gate = '2' THEN 0.90 ELSE 0.85 END AS DOUBLE) AS confidence_score,
    CASE WHEN opened THEN 'Computed facts and passages quoted from notes were weighed together.'
      WHEN gate = '3' THEN 'Neither the admission note nor the tables point to sepsis.' ELSE 'The discharge summary does not state sepsis.' END AS clinical_rationale,
    'keyword_rules:keyword_rules' || CASE WHEN held THEN ':ungrounded_hold' ELSE '' END AS inference_backend,
    concat_ws(' | ', {', '.join(_FLAGS)}) AS review_flags FROM decided)""")
def abstract_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Adjudications of the whole staged abstraction."""
    return _abstracted(spark, folder).adjudications.drop("adjudication_timestamp")


def _criterion(kind: str, met: str, normal: str) -> str:
    """The first abnormal measurement of a visit, or the first one."""
    field, _, places = _FIELDS[kind]
    return f"""SELECT vid, '{field}' AS field_name, 'measurement' AS source_type, CAST(event_id AS VARCHAR) AS source_ref,
      CASE WHEN hit THEN '{met}' || {_digits('level', places)} || ')' ELSE {normal} END AS evidence_quote
    FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY hit DESC, event_id) AS r FROM levels WHERE analyte = '{kind}') WHERE r = 1"""


def _fact(field: str, kind: str, ref: str, quote: str, where: str) -> str:
    return f"SELECT vid, '{field}', '{kind}', {ref}, {quote} FROM decided WHERE {where}"


_EVIDENCE = " UNION ALL ".join((
    _criterion("temp", "Temp(C) triggered (", "'Temp(C) measured normal'"), _criterion("hr", "HR triggered (", "'HR measured normal'"),
    _criterion("rr", "RR/PaCO2 met (", "'RR/PaCO2 normal (PaCO2 unmeasured)'"), _criterion("wbc", "WBC/Bands met (", "'WBC/Bands normal'"),
    _fact("sep3_v3", "culture", "'culture_rows'", "'No culture was positive'", "sep3_v3 = 'NO'"),
    _fact("sep4_v3", "medication", "course_ref", "course_summary", "sep4_v3 IS NOT NULL"),
    """SELECT vid, 'sep6_v3', 'measurement', CAST(event_id AS VARCHAR), 'Peak lactate ' || sep6_v3 || ' mmol/L' FROM decided JOIN
      (SELECT vid, event_id FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY level DESC, event_id) AS r FROM levels WHERE analyte = 'lactate') WHERE r = 1) USING (vid)""",
    _fact("sep7_v3", "measurement", "'daily_sofa'", "'SOFA by day: ' || sep7_v3", "sep7_v3 IS NOT NULL"),
    _fact("sep_day_v3", "measurement", "'sofa_day_' || rise_day", "'SOFA up by ' || (rise_score - rise_previous) || ' under systemic antibiotics on day +' || rise_day", "rise_day IS NOT NULL"),
    _fact("sep_dt_v3", "timeline", "why", "'First sign on day +' || onset_day || ' ' || sep_dt_v3", "sep_dt_v3 IS NOT NULL"),
    f"SELECT vid, 'sep3_v3', 'culture', ref, 'Positive culture: ' || source || ' / ' || organism FROM ({views.CULTURES_SQL}) WHERE {_POSITIVE_CULTURE} AND vid IN (SELECT vid FROM decided)",
    "SELECT vid, 'sepsis_ync_v3', 'clinical_note', 'note:' || note_id, quote FROM q1 WHERE vid IN (SELECT vid FROM decided)",
    "SELECT vid, 'sepsis_uncertain_v3', 'clinical_note', 'note:' || note_id, quote FROM q2 JOIN decided USING (vid) WHERE asked2 AND follow = '1'",
    "SELECT vid, 'sep5_v3', 'clinical_note', 'note:' || note_id, quote FROM cited JOIN decided USING (vid) WHERE opened",
))


@register(f"{COHORT_SQL} SELECT vid AS record_id, vid, field_name, source_type, source_ref, evidence_quote, true AS grounded FROM ({_EVIDENCE})")
def abstract_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence rows of the whole staged abstraction."""
    return _abstracted(spark, folder).evidence


# ------------------------------------------------------------------ parts of it
_DISCHARGES = f"SELECT * FROM ({views.COHORT_NOTES_SQL}) WHERE panel = 'discharge_summary'"


def _anchors(spark: SparkSession, visits: DataFrame) -> DataFrame:
    return reliable_checkpoint(facts.encounters(visits, spark.createDataFrame([], "vid string, moment timestamp_ntz")))


@register(f"""WITH v AS (SELECT DISTINCT user_id AS vid FROM events), d AS ({_DISCHARGES}),
  e AS (SELECT DISTINCT visit_occurrence_id AS vid FROM ({sql.rule_lines(_DISCHARGES, rules.RULES["sepsis"])})),
  a AS (SELECT visit_occurrence_id AS vid, bool_or({_said(abstraction.AMBIGUOUS, "lower(note_text)")}) AS amb FROM d GROUP BY 1)
  SELECT CAST(v.vid AS VARCHAR) AS vid, CASE WHEN a.vid IS NULL THEN '3' WHEN e.vid IS NOT NULL THEN '1' WHEN amb THEN '3' ELSE '2' END AS gate
  FROM v LEFT JOIN e USING (vid) LEFT JOIN a USING (vid)""")
def stage_gates(spark: SparkSession, folder: str) -> DataFrame:
    """First gate of every visit from its discharge summaries."""
    t = _cohort_tables(spark, folder)
    anchors = _anchors(spark, t["visits"])
    notes = charts.panel_notes(t["notes"], anchors)
    lines = spark.createDataFrame([], "vid string, section_order int, section string, line_time timestamp_ntz, line string")
    signals = abstraction.visit_signals(abstraction.piece_signals(notes, lines))
    answers = abstraction.rule_stage1(anchors.select("vid").join(signals, "vid", "left"))
    return answers.select("vid", "gate")


def _pieces(spark: SparkSession, folder: str, per_stage: bool = True) -> tuple[DataFrame, DataFrame, Crowd]:
    """Pieces of the stage views, the visits, and those of them that one task should not put in order."""
    t = _cohort_tables(spark, folder)
    anchors = _anchors(spark, t["visits"])
    crowded = charts.crowded_visits(views.cohort_notes(spark, folder, clinical=False), t["measurements"], t["cultures"], t["drugs"])
    lines = charts.structured_lines(
        facts.measurement_rows(t["measurements"]), facts.culture_rows(t["cultures"]), facts.drug_rows(t["drugs"]), anchors, crowded=crowded)
    return charts.stage_pieces(charts.panel_notes(t["notes"], anchors, crowded=crowded), lines, per_stage), anchors, crowded


@register(f"""WITH v AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS vid FROM events), m AS (SELECT vid, count(*) AS n FROM ({views.MEASUREMENTS_SQL}) GROUP BY 1),
  c AS (SELECT vid, count(*) AS n FROM ({views.CULTURES_SQL}) GROUP BY 1), d AS (SELECT vid, count(*) AS n FROM ({views.DRUGS_SQL}) GROUP BY 1),
  t AS (SELECT CAST(visit_occurrence_id AS VARCHAR) AS vid, count(*) AS n, count(*) FILTER (panel = 'discharge_summary') AS s1, count(*) FILTER (panel = 'hp') AS s2
    FROM ({views.COHORT_NOTES_SQL}) GROUP BY 1),
  j AS (SELECT vid, coalesce(m.n, 0) + coalesce(c.n, 0) + coalesce(d.n, 0) AS lines, coalesce(t.n, 0) AS n, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2
    FROM v LEFT JOIN m USING (vid) LEFT JOIN c USING (vid) LEFT JOIN d USING (vid) LEFT JOIN t USING (vid))
  SELECT vid, stage, pieces FROM j, LATERAL (VALUES ('stage1', s1), ('stage2', s2 + lines), ('stage3', n + lines)) x(stage, pieces) WHERE pieces > 0""")
def stage_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every stage view per visit."""
    return _pieces(spark, folder)[0].groupBy("vid", "stage").agg(F.count(F.lit(1)).alias("pieces"))


def _offset_sql(moment: str) -> str:
    days = f"date_diff('day', DATE '{DAYS_ORIGIN}', CAST({moment} AS DATE))"
    return f"('Day ' || CASE WHEN {days} >= 0 THEN '+' ELSE '' END || {days} || ' ' || strftime({moment}, '%H:%M'))"


_LINES = f"""SELECT vid, 1 AS section_order, '[Structured Vital Signs & Labs]' AS section, moment, '- [' || {_offset_sql('moment')} || '] ' || name || ': ' || CAST(raw AS VARCHAR) || ' k' AS line FROM ({views.MEASUREMENTS_SQL})
  UNION ALL SELECT vid, 2, '[Structured Microbiology]', moment, '- [' || {_offset_sql('moment')} || '] ' || source || ' | ' || organism || ' | ' || result FROM ({views.CULTURES_SQL})
  UNION ALL SELECT vid, 3, '[Structured Medications]', s, '- [' || {_offset_sql('s')} || ' -> ' || {_offset_sql('e')} || '] ' ||
    CASE flag WHEN 'R' THEN 'Vancomycin' WHEN 'A' THEN 'Cefepime' ELSE 'Norepinephrine' END || ' (' || CAST(rate AS VARCHAR) || ') [IV]' FROM ({views.DRUGS_SQL})"""


@register(f"""WITH v AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS vid FROM events), l AS ({_LINES}),
  p AS (SELECT CAST(visit_occurrence_id AS VARCHAR) AS vid, panel, 0 AS section_order, 1 AS kind, note_datetime AS moment, note_id,
      '--- [Note ID: ' || note_id || ' | ' || {_offset_sql('note_datetime')} || ' | Panel: ' || panel || ' | Title: ' || title || '] ---' || chr(10) || note_text AS piece FROM ({views.COHORT_NOTES_SQL})
    UNION ALL SELECT vid, '', section_order, 1, moment, 0, line FROM l
    UNION ALL SELECT DISTINCT vid, '', section_order, 0, TIMESTAMP '0001-01-01', 0, section FROM l),
  s AS (SELECT * FROM p JOIN v USING (vid), (VALUES ('stage1'), ('stage2'), ('stage3')) x(stage)
    WHERE stage = 'stage3' OR (stage = 'stage2' AND panel IN ('', 'hp')) OR (stage = 'stage1' AND panel = 'discharge_summary')),
  w AS (SELECT vid, stage, row_number() OVER (PARTITION BY vid, stage ORDER BY section_order, kind, moment, note_id, piece) AS part, piece FROM s),
  every AS (SELECT vid, stage, coalesce(part, 1) AS part, coalesce(piece, missing) AS piece FROM v JOIN (VALUES ('stage1', '{fixed.NO_DISCHARGE}'), ('stage2', '{fixed.NO_STAGE2}'), ('stage3', '{fixed.NO_STAGE3}')) x(stage, missing) ON true
    LEFT JOIN w USING (vid, stage))
  SELECT vid, stage, count(*) AS parts, CAST(sum(CAST('0x' || substr(md5(part || ' ' || piece), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM every GROUP BY 1, 2""")
def stage_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text and order of every stage view, as a digest that gathers no view."""
    pieces, visits, crowded = _pieces(spark, folder, per_stage=False)
    shown = charts.stage_views(pieces, visits, crowded)
    return shown.groupBy("vid", "stage").agg(
        F.count(F.lit(1)).alias("parts"), F.sum(text_digest(F.concat_ws(" ", F.col("part").cast("string"), "view"))).alias("digest"))
