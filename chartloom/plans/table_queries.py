"""Queries over structured tables: facts, intervals, agreement, linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.operators import agreement, facts, intervals
from chartloom.plans import sql, views
from chartloom.plans.registry import register

# ------------------------------------------------------------------ structured facts
T0 = "2024-01-10 12:00:00"
DAYS_ORIGIN = "2024-01-10"


def _tables(spark: SparkSession, folder: str) -> facts.ChartTables:
    return facts.ChartTables(
        anchors=_anchors(spark, folder),
        measurements=facts.measurement_rows(views.measurements(spark, folder)),
        drugs=facts.drug_rows(views.order_drugs(spark, folder)),
        cultures=facts.culture_rows(views.part_cultures(spark, folder)),
    )


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    nothing = spark.createDataFrame([], "vid string, moment timestamp_ntz")
    return facts.encounters(views.user_visits(spark, folder), nothing)


DAYS_SQL = f"""SELECT vid, CAST(date_diff('day', DATE '2024-01-10', dated) AS INTEGER) AS day,
  max(CASE WHEN analyte = 'creatinine' THEN level END) AS creatinine,
  min(CASE WHEN analyte = 'platelets' THEN level END) AS platelets,
  max(CASE WHEN analyte = 'bilirubin' THEN level END) AS bilirubin,
  min(CASE WHEN analyte = 'map' THEN level END) AS map, min(CASE WHEN analyte = 'gcs' THEN level END) AS gcs
  FROM ({views.LEVELS_SQL}) GROUP BY 1, 2"""
DRUG_DAYS_SQL = f"""SELECT vid, day, max(points) AS points FROM (SELECT vid, CASE WHEN rate > 0.1 THEN 4 ELSE 3 END AS points,
  unnest(range(date_diff('day', DATE '2024-01-10', CAST(s AS DATE)), date_diff('day', DATE '2024-01-10', CAST(e AS DATE)) + 1)) AS day
  FROM ({views.DRUGS_SQL}) WHERE flag = 'N' AND vid IN (SELECT vid FROM ({views.MEASUREMENTS_SQL}))) GROUP BY 1, 2"""
SCORES_SQL = f"""SELECT vid, day, coagulation, liver, cardiovascular, cns, renal, coalesce(coagulation, 0) + coalesce(liver, 0)
  + coalesce(cardiovascular, 0) + coalesce(cns, 0) + coalesce(renal, 0) AS score FROM (SELECT vid, day,
  CASE WHEN platelets < 20 THEN 4 WHEN platelets < 50 THEN 3 WHEN platelets < 100 THEN 2 WHEN platelets < 150 THEN 1
       WHEN platelets IS NOT NULL THEN 0 END AS coagulation,
  CASE WHEN bilirubin >= 12 THEN 4 WHEN bilirubin >= 6 THEN 3 WHEN bilirubin >= 2 THEN 2 WHEN bilirubin >= 1.2 THEN 1
       WHEN bilirubin IS NOT NULL THEN 0 END AS liver,
  CASE WHEN points > 0 THEN points WHEN map < 70 THEN 1 WHEN map IS NOT NULL THEN 0 END AS cardiovascular,
  CASE WHEN gcs < 6 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs <= 14 THEN 1 WHEN gcs IS NOT NULL THEN 0 END AS cns,
  CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1
       WHEN creatinine IS NOT NULL THEN 0 END AS renal
  FROM (SELECT coalesce(a.vid, b.vid) AS vid, coalesce(a.day, b.day) AS day, creatinine, platelets, bilirubin, map, gcs, points
        FROM ({DAYS_SQL}) a FULL JOIN ({DRUG_DAYS_SQL}) b ON a.vid = b.vid AND a.day = b.day))
  WHERE coalesce(coagulation, liver, cardiovascular, cns, renal) IS NOT NULL"""


@register(f"SELECT vid, CAST(day AS BIGINT) AS day, coagulation, liver, cardiovascular, cns, renal, score FROM ({SCORES_SQL})")
def daily_scores(spark: SparkSession, folder: str) -> DataFrame:
    t = _tables(spark, folder)
    scores = facts.daily_scores(facts.day_profile(t.measurements, t.anchors), t.drugs, t.anchors)
    return scores.select("vid", F.col("day").cast("bigint").alias("day"), "coagulation", "liver", "cardiovascular", "cns",
                         "renal", "score")


ABX_DAYS_SQL = f"""SELECT DISTINCT vid, unnest(range(date_diff('day', DATE '2024-01-10', CAST(s AS DATE)),
  date_diff('day', DATE '2024-01-10', CAST(e AS DATE)) + 1)) AS day FROM ({views.DRUGS_SQL}) WHERE flag IN ('R', 'A')
  AND vid IN (SELECT vid FROM ({views.MEASUREMENTS_SQL}))"""
RISE_SQL = f"""WITH s AS ({SCORES_SQL}) SELECT a.vid, CAST(a.day AS BIGINT) AS day, a.score, b.score AS previous
  FROM s a JOIN s b ON a.vid = b.vid AND b.day = a.day - 1 JOIN ({ABX_DAYS_SQL}) d ON d.vid = a.vid AND d.day = a.day
  WHERE a.day >= 0 AND a.score - b.score >= 2"""


@register(RISE_SQL)
def score_rise(spark: SparkSession, folder: str) -> DataFrame:
    """Days on an antibiotic on which the score rose by two or more."""
    t = _tables(spark, folder)
    scores = facts.daily_scores(facts.day_profile(t.measurements, t.anchors), t.drugs, t.anchors).select("vid", "day", "score")
    spans = facts.antibiotic_spans(facts.antibiotic_intervals(t.drugs), t.anchors)
    return facts.rise_days(scores, spans).select("vid", F.col("day").cast("bigint").alias("day"), "score", "previous")


@register(f"SELECT vid, CAST(day AS BIGINT) AS day FROM ({ABX_DAYS_SQL})")
def drug_day_cover(spark: SparkSession, folder: str) -> DataFrame:
    anchors = _anchors(spark, folder)
    drugs = facts.drug_rows(views.order_drugs(spark, folder))
    days = facts.antibiotic_days(facts.antibiotic_intervals(drugs), anchors)
    return days.select("vid", F.col("day").cast("bigint").alias("day"))


ABNORMAL_SQL = """CASE analyte WHEN 'temp' THEN level > 38 OR level < 36 WHEN 'hr' THEN level > 90 WHEN 'rr' THEN level > 20
  WHEN 'wbc' THEN level > 12 OR level < 4 WHEN 'lactate' THEN level > 2 END"""
_FIRST_POSITIVE = f"""SELECT vid, string_agg(finding, '; ' ORDER BY place) AS listed FROM (
  SELECT vid, source || ', ' || organism || ', (+)' AS finding, min(place) AS place FROM ({views.CULTURES_SQL})
  WHERE result <> 'negative' AND organism NOT IN ('', 'No growth') GROUP BY 1, 2) GROUP BY 1"""
EPISODES = """WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY s, ref) AS r FROM ({rows})),
  f AS (SELECT vid, r, s AS es, e AS ee, trough AS et, ref AS er, 1 AS ep FROM i WHERE r = 1
    UNION ALL SELECT i.vid, i.r,
      CASE WHEN joins THEN f.es ELSE i.s END, CASE WHEN joins THEN greatest(f.ee, i.e) ELSE i.e END,
      CASE WHEN joins THEN f.et OR i.trough ELSE i.trough END, CASE WHEN joins THEN f.er ELSE i.ref END,
      CASE WHEN joins THEN f.ep ELSE f.ep + 1 END
    FROM f JOIN i ON i.vid = f.vid AND i.r = f.r + 1,
      LATERAL (SELECT epoch(i.s) - epoch(f.ee) <= 3600 * CASE WHEN i.trough OR f.et THEN {long} ELSE 24 END AS joins))
  SELECT vid, ep, min(es) AS s, max(ee) AS e, bool_or(et) AS trough, min(er) AS ref, count(*) AS parts FROM f GROUP BY 1, 2"""


def episodes_sql(rows: str, long: int = 48) -> str:
    """Episodes by walking the sorted intervals one by one."""
    return EPISODES.format(rows=rows, long=long)


_ABX_ROWS = f"""SELECT vid, s, e, flag = 'R' AS trough, '' AS ref FROM ({views.DRUGS_SQL}) WHERE flag IN ('R', 'A')
  AND vid IN (SELECT vid FROM ({views.MEASUREMENTS_SQL}))"""


FACTS_SQL = f"""WITH v AS (SELECT DISTINCT vid FROM ({views.MEASUREMENTS_SQL})), l AS (SELECT *, {ABNORMAL_SQL} AS hit FROM ({views.LEVELS_SQL})),
  c AS (SELECT vid, listed FROM ({_FIRST_POSITIVE})), course AS (SELECT vid, min(s) AS s FROM ({episodes_sql(_ABX_ROWS)})
    WHERE epoch(e) - epoch(s) > 86400 GROUP BY 1),
  given AS (SELECT DISTINCT vid FROM ({views.DRUGS_SQL})), cultured AS (SELECT DISTINCT vid FROM ({views.CULTURES_SQL})),
  ev AS (SELECT vid, moment FROM l WHERE hit UNION ALL SELECT vid, moment FROM ({views.CULTURES_SQL})
      WHERE result <> 'negative' AND organism NOT IN ('', 'No growth') UNION ALL SELECT vid, s FROM course),
  o AS (SELECT vid, coalesce(min(CASE WHEN moment >= TIMESTAMP '2024-01-08 12:00:00' THEN moment END), min(moment)) AS onset
    FROM ev GROUP BY 1),
  f AS (SELECT vid, max(CASE WHEN analyte = 'temp' THEN CASE WHEN hit THEN '1' ELSE '0' END END) AS sep1_v3___1,
    max(CASE WHEN analyte = 'hr' THEN CASE WHEN hit THEN '1' ELSE '0' END END) AS sep1_v3___2,
    max(CASE WHEN analyte = 'rr' THEN CASE WHEN hit THEN '1' ELSE '0' END END) AS sep1_v3___3,
    max(CASE WHEN analyte = 'wbc' THEN CASE WHEN hit THEN '1' ELSE '0' END END) AS sep1_v3___4,
    max(CASE WHEN analyte = 'lactate' THEN level END) AS lactate FROM l GROUP BY 1),
  d AS (SELECT vid, string_agg(CAST(score AS VARCHAR), ', ' ORDER BY day) AS sep7_v3 FROM ({SCORES_SQL}) WHERE day >= 0 GROUP BY 1),
  r AS (SELECT vid, CAST(min(day) AS VARCHAR) AS sep_day_v3 FROM ({RISE_SQL}) GROUP BY 1)
  SELECT v.vid, sep1_v3___1, sep1_v3___2, sep1_v3___3, sep1_v3___4,
    CASE WHEN c.listed IS NOT NULL THEN c.listed WHEN cultured.vid IS NOT NULL THEN 'NO' END AS sep3_v3,
    CASE WHEN course.vid IS NOT NULL THEN '1' WHEN given.vid IS NOT NULL THEN '0' END AS sep4_v3,
    lactate, sep7_v3, sep_day_v3, strftime(onset, '%H:%M') AS sep_dt_v3,
    CAST(greatest(date_diff('day', DATE '2024-01-10', CAST(onset AS DATE)), 0) AS VARCHAR) AS sep_days,
    CAST(CAST((epoch(onset) - epoch(TIMESTAMP '{T0}')) / 60 AS BIGINT) AS VARCHAR) AS sep_time
  FROM v LEFT JOIN f USING (vid) LEFT JOIN c USING (vid) LEFT JOIN cultured USING (vid) LEFT JOIN course USING (vid)
    LEFT JOIN given USING (vid) LEFT JOIN d USING (vid) LEFT JOIN r USING (vid) LEFT JOIN o USING (vid)"""


@register(FACTS_SQL)
def structured_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria, culture summary, courses, scores, rise day and onset per visit."""
    t = _tables(spark, folder)
    rows = facts.structured_facts(t.anchors, t.measurements, t.drugs, t.cultures)
    return rows.select(
        "vid", "sep1_v3___1", "sep1_v3___2", "sep1_v3___3", "sep1_v3___4", "sep3_v3", "sep4_v3",
        "lactate", "sep7_v3", "sep_day_v3", "sep_dt_v3", "sep_days", "sep_time")


@register(f"""SELECT vid, analyte, count(*) FILTER ({ABNORMAL_SQL}) > 0 AS abnormal, arg_min(event_id, event_id) AS first_ref
  FROM ({views.LEVELS_SQL}) WHERE analyte IN ('temp', 'hr', 'rr', 'wbc', 'lactate') GROUP BY 1, 2""")
def tri_state_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Per visit and analyte: measured, abnormal, and its first row."""
    profile = facts.day_profile(facts.measurement_rows(views.measurements(spark, folder)), _anchors(spark, folder))
    rows = profile.filter(F.col("analyte").isin("temp", "hr", "rr", "wbc", "lactate")).groupBy("vid", "analyte").agg(
        F.min("seen").alias("seen"), F.min("hit").alias("hit"))
    return rows.select("vid", "analyte", F.col("hit").isNotNull().alias("abnormal"),
                       F.col("seen.ref").cast("bigint").alias("first_ref"))


@register(f"""SELECT vid, level AS peak, event_id AS ref FROM (SELECT *, row_number() OVER (PARTITION BY vid
  ORDER BY level DESC, event_id) AS r FROM ({views.LEVELS_SQL}) WHERE analyte = 'lactate') WHERE r = 1""")
def peak_value(spark: SparkSession, folder: str) -> DataFrame:
    """Highest lactate per visit; the first row wins a tie."""
    rows = facts.measurement_rows(views.measurements(spark, folder)).filter("analyte = 'lactate'")
    top = rows.groupBy("vid").agg(F.min(F.struct((-F.col("level")).alias("minus"), "row_order")).alias("top"))
    return top.select("vid", (-F.col("top.minus")).alias("peak"), F.col("top.row_order").alias("ref"))


@register("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS vid, date_trunc('minute', ts) AS m FROM events),
  v AS (SELECT CAST(o_orderkey AS VARCHAR) AS vid, o_orderkey,
    CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2024-01-09 08:00:00' END AS icu,
    CASE WHEN o_orderkey % 4 = 1 THEN TIMESTAMP '2024-01-07 06:30:00' END AS vstart,
    CASE WHEN o_orderkey % 4 = 2 THEN DATE '2024-01-05' END AS base FROM orders),
  j AS (SELECT v.*, (SELECT min(m) FROM e WHERE e.vid = v.vid AND CAST(m AS DATE) = base) AS same,
    (SELECT min(m) FROM e WHERE e.vid = v.vid) AS first FROM v)
  SELECT vid, coalesce(strftime(coalesce(icu, vstart, same, CAST(base AS TIMESTAMP), first), '%Y-%m-%d %H:%M'), '') AS t0,
    CASE WHEN icu IS NOT NULL THEN 'icu_admit_datetime' WHEN vstart IS NOT NULL THEN 'visit_start_datetime'
      WHEN same IS NOT NULL THEN 'earliest_same_day_event' WHEN base IS NOT NULL THEN 'visit_start_date_midnight'
      WHEN first IS NOT NULL THEN 'earliest_event' ELSE 'missing' END AS t0_source FROM j""")
def t0_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Reference time of every visit from four kinds of visit rows."""
    k = F.col("o_orderkey") % 4
    visits = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("visit_occurrence_id"), F.col("o_custkey").alias("person_id"),
        F.when(k == 0, "2024-01-09 08:00:00").alias("icu_admit_datetime"),
        F.when(k == 1, "2024-01-07 06:30").when(k == 2, "2024-01-05").alias("visit_start_datetime"))
    events = facts.measurement_rows(views.measurements(spark, folder)).select("vid", "moment")
    rows = facts.encounters(visits, events)
    return rows.select("vid", F.coalesce(F.date_format("t0_time", "yyyy-MM-dd HH:mm"), F.lit("")).alias("t0"), "t0_source")


# ------------------------------------------------------------------ intervals
def _episodes(df: DataFrame) -> DataFrame:
    return df.select("vid", F.date_format("start_time", "yyyy-MM-dd HH:mm").alias("start"),
                     F.date_format("end_time", "yyyy-MM-dd HH:mm").alias("finish"), F.round("hours", 3).alias("hours"),
                     F.col("is_trough").alias("trough"), "ref", "parts")


_EPISODE_COLUMNS = """SELECT vid, strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(e, '%Y-%m-%d %H:%M') AS finish,
  round((epoch(e) - epoch(s)) / 3600.0, 3) AS hours, trough, {ref} AS ref, parts"""


@register(_EPISODE_COLUMNS.format(ref="ref") + f""" FROM (SELECT vid, min(s) AS s, max(e) AS e, bool_or(trough) AS trough,
    arg_min(ref, (s, ref)) AS ref, count(*) AS parts FROM (SELECT *, sum(CASE WHEN epoch(s) - epoch(before) <= 86400 THEN 0 ELSE 1 END)
      OVER (PARTITION BY vid ORDER BY s, ref) AS island FROM (SELECT *, max(e) OVER (PARTITION BY vid ORDER BY s, ref
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({views.INTERVALS_SQL}))) GROUP BY vid, island)""")
def interval_merge_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _episodes(intervals.merge_episodes(views.supplier_intervals(spark, folder), trough_gap_hours=24))


_WALK = f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY s, ref) AS r FROM ({views.INTERVALS_SQL})),
  f AS (SELECT vid, r, s AS es, e AS ee, trough AS et, ref AS er FROM i WHERE r = 1
    UNION ALL SELECT i.vid, i.r, CASE WHEN j THEN f.es ELSE i.s END, CASE WHEN j THEN greatest(f.ee, i.e) ELSE i.e END,
      CASE WHEN j THEN f.et OR i.trough ELSE i.trough END, CASE WHEN j THEN f.er ELSE i.ref END
    FROM f JOIN i ON i.vid = f.vid AND i.r = f.r + 1,
      LATERAL (SELECT epoch(i.s) - epoch(f.ee) <= 3600 * CASE WHEN i.trough OR f.et THEN 48 ELSE 24 END AS j))"""


@register(_EPISODE_COLUMNS.format(ref="ref") + f""" FROM ({_WALK}
  SELECT vid, es AS s, max(ee) AS e, bool_or(et) AS trough, min(er) AS ref, count(*) AS parts FROM f GROUP BY vid, es)""")
def interval_merge_trough(spark: SparkSession, folder: str) -> DataFrame:
    """The longer gap for trough drugs, checked by walking the intervals one by one."""
    return _episodes(intervals.merge_episodes(views.supplier_intervals(spark, folder)))


# ------------------------------------------------------------------ agreement
def _gates(spark: SparkSession, folder: str) -> DataFrame:
    labels = views.table(spark, folder, "labels")
    docs = views.table(spark, folder, "documents").select("doc_id", "n_chars", "lang")
    return labels.join(docs, "doc_id").select(
        "doc_id", "toxic", "lang",
        (F.col("quality") == 1).alias("human_positive"),
        F.when(F.col("n_chars") % 13 != 0, F.col("n_chars") > 600).alias("llm_positive"),
        (F.lit(1) + F.col("doc_id") % 5).cast("string").alias("conf1"),
        (F.lit(1) + F.col("quality") + F.col("toxic")).cast("string").alias("h_gate"),
        (F.lit(1) + F.col("n_chars") % 3).cast("string").alias("l_gate"))


_GATES = """SELECT doc_id, toxic, quality = 1 AS h, CASE WHEN n_chars % 13 <> 0 THEN n_chars > 600 END AS m,
  CAST(1 + doc_id % 5 AS VARCHAR) AS conf1, CAST(1 + quality + toxic AS VARCHAR) AS hg, CAST(1 + n_chars % 3 AS VARCHAR) AS mg
  FROM labels JOIN documents USING (doc_id)"""


@register(sql.agreement(f"SELECT {sql.COUNTS} FROM ({_GATES})"))
def binary_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.binary_agreement(_gates(spark, folder))


@register(sql.agreement(f"""SELECT CASE WHEN conf1 IN ('4', '5') THEN 'high_confidence_4_5' ELSE 'low_confidence_1_3' END AS stratum,
  {sql.COUNTS} FROM ({_GATES}) WHERE m IS NOT NULL GROUP BY 1""", "stratum"))
def stratified_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.stratified_agreement(_gates(spark, folder))


@register(f"""SELECT a.x AS human, b.x AS model, coalesce(n, 0) AS n FROM (VALUES ('1'), ('2'), ('3')) a(x),
  (VALUES ('1'), ('2'), ('3')) b(x) LEFT JOIN (SELECT hg, mg, count(*) AS n FROM ({_GATES}) GROUP BY 1, 2) ON hg = a.x AND mg = b.x""")
def gate_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.gate_matrix(agreement.gate_cells(_gates(spark, folder)))


def _kappa_sql(gates: str) -> str:
    return f"""WITH g AS ({gates}), t AS (SELECT count(*)::DOUBLE AS n FROM g), c AS (SELECT h, m, count(*)::DOUBLE AS o FROM g GROUP BY 1, 2),
      r AS (SELECT h, sum(o) AS o FROM c GROUP BY 1), k AS (SELECT m, sum(o) AS o FROM c GROUP BY 1),
      e AS (SELECT r.h, k.m, r.o * k.o / n AS x FROM r, k, t),
      p(v, pos) AS (VALUES ('2', 0), ('3', 1), ('1', 2)),
      s AS (SELECT (SELECT coalesce(sum(o), 0) FROM c WHERE h = m) / n AS po, (SELECT coalesce(sum(x), 0) FROM e WHERE h = m) / n AS pe,
        (SELECT coalesce(sum(o * abs(a.pos - b.pos) / 2), 0) FROM c JOIN p a ON a.v = h JOIN p b ON b.v = m) AS seen,
        (SELECT coalesce(sum(x * abs(a.pos - b.pos) / 2), 0) FROM e JOIN p a ON a.v = h JOIN p b ON b.v = m) AS chance, n FROM t)
      SELECT CAST(n AS BIGINT) AS paired_n, round(po * 100, 1) AS overall_agreement_pct,
        CASE WHEN abs(1 - pe) > 1e-9 THEN round((po - pe) / (1 - pe), 3) WHEN abs(po - 1) <= 1e-9 THEN 1.0 ELSE 0.0 END AS unweighted_kappa,
        CASE WHEN abs(chance) > 1e-9 THEN round(1 - seen / chance, 3) WHEN abs(seen) <= 1e-9 THEN 1.0 ELSE 0.0 END AS linear_weighted_kappa
      FROM s"""


@register(_kappa_sql(f"SELECT hg AS h, mg AS m FROM ({_GATES})"))
def weighted_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.gate_figures(agreement.gate_cells(_gates(spark, folder)))


# ------------------------------------------------------------------ two survey tables
def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.pair_rows(views.human_rows(spark, folder), views.model_rows(spark, folder))


def _gate(column: str) -> str:
    low = f"lower(trim({column}))"
    return (f"CASE WHEN {low} IN ('1', 'yes', 'y', 'true') THEN '1' WHEN {low} IN ('2', 'no', 'n', 'false') THEN '2' "
            f"WHEN {low} IN ('3', 'i am not sure', 'not sure', 'uncertain') THEN '3' END")


def _resolved(side: str) -> str:
    first, second = _gate(f"{side}.sepsis_ync_v3"), _gate(f"{side}.sepsis_uncertain_v3")
    return (f"CASE WHEN {first} = '1' THEN true WHEN {first} = '2' THEN false WHEN {first} = '3' AND {second} = '1' THEN true "
            f"WHEN {first} = '3' AND {second} = '2' THEN false END")


def _first(column: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({column}, '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE)"


def _list(column: str) -> str:
    return (rf"list_filter(list_transform(regexp_split_to_array({column}, '[,;]+'), "
            rf"lambda x: TRY_CAST(nullif(regexp_extract(x, '-?\d+(?:\.\d+)?', 0), '') AS DOUBLE)), lambda x: x IS NOT NULL)")


def _minutes(column: str) -> str:
    part = [rf"TRY_CAST(nullif(regexp_extract(trim({column}), '^(\d{{1,2}}):(\d{{2}})(?::\d{{2}})?$', {n}), '') AS INTEGER)" for n in (1, 2)]
    return f"CASE WHEN {part[0]} <= 23 AND {part[1]} <= 59 THEN {part[0]} * 60 + {part[1]} END"


_PAIR = f"""WITH h AS ({views.HUMAN_SQL}), m AS ({views.MODEL_SQL}), p AS (SELECT h, m, h.vid IS NOT NULL AS has_h, m.vid IS NOT NULL AS has_m,
  {_gate("h.sepsis_ync_v3")} AS hg, {_gate("m.sepsis_ync_v3")} AS mg, {_gate("h.sepsis_uncertain_v3")} AS hf,
  {_gate("m.sepsis_uncertain_v3")} AS mf, {_resolved("h")} AS hr, {_resolved("m")} AS mr
  FROM h FULL JOIN m ON h.institution_v3 = m.institution_v3 AND h.record_id = m.record_id AND h.vid = m.vid),
  matched AS (SELECT * FROM p WHERE has_h AND has_m), opened AS (SELECT * FROM matched WHERE hr AND mr)"""


@register(_PAIR + """ SELECT count(*) FILTER (has_h AND has_m) AS matched_encounters, count(*) FILTER (has_h AND NOT has_m) AS human_only_encounters,
  count(*) FILTER (has_m AND NOT has_h) AS llm_only_encounters, count(*) FILTER (has_h AND has_m AND hr AND mr) AS shared_open_branch_n FROM p""")
def key_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.key_counts(_pairs(spark, folder))


@register(f"""WITH x AS ({sql.agreement(_PAIR + " SELECT sum(CASE WHEN hr AND mr THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN NOT hr AND mr THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN hr AND NOT mr THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT hr AND NOT mr THEN 1 ELSE 0 END) AS tn FROM matched")}),
  u AS ({_PAIR} SELECT count(*) FILTER (hr IS NULL) AS unresolved_human_n, count(*) FILTER (mr IS NULL) AS unresolved_llm_n FROM matched)
  SELECT * FROM x, u""")
def resolved_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.resolved_agreement(_pairs(spark, folder))


def _yes(column: str) -> str:
    low = f"lower(trim({column}))"
    return (f"CASE WHEN {low} IN ('1', 'yes', 'y', 'true', 'checked', 'confirmed') THEN true "
            f"WHEN {low} IN ('0', 'no', 'n', 'false', 'unchecked') THEN false END")


def _culture(column: str) -> str:
    return (f"CASE WHEN trim({column}) = '' THEN NULL WHEN lower(trim({column})) IN ('no', 'none', 'negative', 'neg', 'n/a', 'na', "
            f"'no growth') THEN false ELSE true END")


def _organisms(column: str) -> str:
    from chartloom import fixed_values as fixed

    ignored = ", ".join(f"'{w}'" for w in fixed.ORGANISM_IGNORED_WORDS)
    return (rf"list_distinct(list_filter(regexp_extract_all(regexp_replace(lower({column}), '\(\+\)|\(-\)|\+', ' ', 'g'), '[a-z0-9]+'), "
            rf"lambda w: length(w) >= 2 AND w NOT IN ({ignored})))")


def _items_sql() -> str:
    from chartloom import fixed_values as fixed

    cells = ", ".join(f"('{i}', {_yes('h.' + i)}, {_yes('m.' + i)}, NULL::DOUBLE)" for i in fixed.AGREEMENT_ITEMS)
    ho, mo = _organisms("h.sep3_v3"), _organisms("m.sep3_v3")
    union = f"len(list_distinct(list_concat({ho}, {mo})))"
    overlap = f"CASE WHEN {_culture('h.sep3_v3')} AND {_culture('m.sep3_v3')} AND {union} > 0 THEN len(list_intersect({ho}, {mo})) / {union} END"
    cells += f", ('sep3_v3_positive', {_culture('h.sep3_v3')}, {_culture('m.sep3_v3')}, {overlap})"
    counts = f"""{_PAIR}, c AS (SELECT t.* FROM opened, LATERAL (VALUES {cells}) t(field, h, m, overlap))
      SELECT field, {sql.COUNTS}, count(*) AS shared_branch_n, count(*) FILTER (m IS NULL) AS llm_missing_count,
      count(*) FILTER (h IS NULL) AS human_missing_count, round(avg(overlap), 3) AS organism_jaccard_mean FROM c GROUP BY 1"""
    return sql.agreement(counts, "field, shared_branch_n, llm_missing_count, human_missing_count, organism_jaccard_mean")


@register(_items_sql())
def item_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.item_agreement(_pairs(spark, folder))


_ERRORS = {
    "lactate_error": (f"abs({_first('h.sep6_v3')} - {_first('m.sep6_v3')})", 0.2),
    "score_day0_error": (f"abs({_list('h.sep7_v3')}[1] - {_list('m.sep7_v3')}[1])", 1.0),
    "score_peak_error": (f"abs(list_max({_list('h.sep7_v3')}) - list_max({_list('m.sep7_v3')}))", 1.0),
    "rise_day_error": (f"abs({_first('h.sep_day_v3')} - {_first('m.sep_day_v3')})", 1.0),
    "onset_day_error": (f"abs({_first('h.sep_days')} - {_first('m.sep_days')})", 1.0),
    "onset_hour_error": (
        f"abs(({_first('h.sep_days')} * 24 + ({_minutes('h.sep_dt_v3')}) / 60::DOUBLE) - ({_first('m.sep_days')} * 24 + ({_minutes('m.sep_dt_v3')}) / 60::DOUBLE))", 1.0),
}
_ERROR_ROWS = ", ".join(f"('{name}', CAST({error} AS DOUBLE), {limit}::DOUBLE)" for name, (error, limit) in _ERRORS.items())


@register(f"""{_PAIR}, c AS (SELECT t.* FROM opened, LATERAL (VALUES {_ERROR_ROWS}) t(metric, e, lim))
  SELECT metric, count(e) AS paired_n, round(avg(e), 3) AS mean_error,
    CASE WHEN count(e) > 0 THEN round(100.0 * count(*) FILTER (e = 0) / count(e), 1) END::DOUBLE AS exact_pct,
    CASE WHEN count(e) > 0 THEN round(100.0 * count(*) FILTER (e <= lim + 1e-9) / count(e), 1) END::DOUBLE AS within_pct,
    CASE WHEN metric = 'lactate_error' THEN round(median(round(e, 6)), 3) END AS median_error FROM c GROUP BY metric""")
def numeric_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.numeric_agreement(_pairs(spark, folder))


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as field evidence of the model rows."""
    fields = F.array(*(F.lit(f) for f in ("sepsis_ync_v3", "sep1_v3", "sep6_v3", "sep_surg_v3___1")))
    return views.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("record_id"), F.col("l_orderkey").cast("string").alias("vid"),
        F.element_at(fields, (F.col("l_partkey") % 4 + 1).cast("int")).alias("field_name"),
        (F.col("l_partkey") * 100 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("evidence_order"),
        F.format_string("part %d line %d", "l_partkey", "l_linenumber").alias("evidence_quote"),
        F.format_string("supplier:%d", "l_suppkey").alias("source_ref"))


def _discrepancy_sql() -> str:
    from chartloom import fixed_values as fixed

    def flag(value: str) -> str:
        return f"CASE WHEN {value} THEN '1' WHEN NOT {value} THEN '0' END"

    rows = ["('sepsis_ync_v3', hg <> mg, hg, mg)",
            "('sepsis_uncertain_v3', hg = '3' AND mg = '3' AND hf IS DISTINCT FROM mf, hf, mf)",
            f"('gate_resolved', hr <> mr, {flag('hr')}, {flag('mr')})"]
    for i in fixed.AGREEMENT_ITEMS:
        h, m = f"({_yes('h.' + i)})", f"({_yes('m.' + i)})"
        rows.append(f"('{i}', hr AND mr AND {h} <> {m}, {flag(h)}, {flag(m)})")
    rows.append(f"('sep3_v3_positive', hr AND mr AND {_culture('h.sep3_v3')} <> {_culture('m.sep3_v3')}, h.sep3_v3, m.sep3_v3)")
    for error, limit, name in (("lactate_error", 0.2, "sep6_v3"), ("score_peak_error", 1, "sep7_v3"),
                               ("rise_day_error", 0, "sep_day_v3"), ("onset_day_error", 0, "sep_days")):
        rows.append(f"('{name}', hr AND mr AND {_ERRORS[error][0]} > {limit}, h.{name}, m.{name})")
    return f"""{_PAIR}, d AS (SELECT h.vid AS vid, h.conf1 AS conf1, t.field, coalesce(t.hv, '') AS hv, coalesce(t.mv, '') AS mv
        FROM matched, LATERAL (VALUES {', '.join(rows)}) t(field, differs, hv, mv) WHERE t.differs),
      ev AS (SELECT CAST(l_orderkey AS VARCHAR) AS vid, ['sepsis_ync_v3', 'sep1_v3', 'sep6_v3', 'sep_surg_v3___1'][l_partkey % 4 + 1] AS field,
        l_partkey * 100 + l_suppkey * 10 + l_linenumber AS place, printf('part %d line %d', l_partkey, l_linenumber) AS quote,
        printf('supplier:%d', l_suppkey) AS ref FROM lineitem),
      ef AS (SELECT vid, field, arg_min(quote, (place, quote, ref)) AS quote, arg_min(ref, (place, quote, ref)) AS ref FROM ev GROUP BY 1, 2),
      ea AS (SELECT vid, arg_min(quote, (place, quote, ref)) AS quote, arg_min(ref, (place, quote, ref)) AS ref FROM ev GROUP BY 1)
      SELECT '7' AS institution_v3, d.vid AS record_id, d.vid, d.field, hv AS human_value, mv AS llm_value, conf1 AS clinician_conf1,
        CASE WHEN d.field IN ('sepsis_ync_v3', 'sepsis_uncertain_v3', 'gate_resolved') THEN 'gate_classification_mismatch'
          WHEN starts_with(d.field, 'sep1_v3') THEN 'sirs_criterion_mismatch'
          WHEN starts_with(d.field, 'sep_surg_v3') THEN 'surgical_trauma_confounder_mismatch'
          WHEN d.field IN ('sep3_v3', 'sep3_v3_positive', 'sep4_v3') THEN 'infection_or_antibiotic_mismatch'
          WHEN d.field IN ('sep6_v3', 'sep7_v3') THEN 'organ_dysfunction_or_lactate_mismatch'
          WHEN d.field IN ('sep_day_v3', 'sep_days', 'sep_dt_v3') THEN 'onset_timing_mismatch' ELSE 'field_mismatch' END AS discrepancy_category,
        coalesce(a.quote, b.quote, c.quote, '') AS llm_evidence_quote, coalesce(a.ref, b.ref, c.ref, '') AS llm_source_ref
      FROM d LEFT JOIN ef a ON a.vid = d.vid AND a.field = d.field
        LEFT JOIN ef b ON b.vid = d.vid AND b.field = string_split(d.field, '___')[1] LEFT JOIN ea c ON c.vid = d.vid"""


@register(_discrepancy_sql())
def discrepancies(spark: SparkSession, folder: str) -> DataFrame:
    """Every difference of two survey tables with the model's evidence for it."""
    return agreement.discrepancies(_pairs(spark, folder), _evidence(spark, folder))
