"""Queries over adjudications, model answers, survey rows and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.operators import charts, export, facts, quality, responses, rules, survey
from chartloom.plans import sql, views
from chartloom.plans.registry import register
from chartloom.session import shared_folder
from chartloom.sources import tables
from chartloom.streaming import incremental, repair

RUN_TS = "2026-01-31T00:00:00+00:00"


def pick(number: Column, *options: str) -> Column:
    return F.element_at(F.array(*(F.lit(o) for o in options)), (number % len(options) + 1).cast("int"))


# ------------------------------------------------------------------ model answers
SAID = ("probable", "Ruled-out", "TRUE", "unknown", "maybe so", "Definite")
SCORES = ('"94%"', "88", "0.4", "null")


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """documents as raw model answers: fenced, wrapped in prose, nested, cut off, plain."""
    docs = views.spread(views.table(spark, folder, "documents").select("doc_id", "text"))
    words = F.regexp_replace("text", r"[^\p{L}\p{N}., ]", " ")
    comma = F.when(F.col("doc_id") % 2 == 0, ",").otherwise("")
    body = F.concat(
        F.lit('{"phenotype_status": "'), pick(F.col("doc_id"), *SAID), F.lit('", "confidence_score": '),
        pick(F.col("doc_id"), *SCORES), F.lit(', "clinical_rationale": "'), words, F.lit('", "key_evidence": [{"evidence_quote": "'),
        F.substring(words, 1, 40), F.lit('", "note_id": "note '), F.col("doc_id").cast("string"), F.lit('"}'), comma, F.lit("]"),
        comma, F.lit("}"))
    k = F.col("doc_id") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k == 1, F.concat(F.lit("Sure. "), body, F.lit(" Hope {this} helps")))
        .when(k == 2, F.concat(F.lit('{"answer": '), body, F.lit("}")))
        .when(k == 3, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int")))
        .otherwise(body))
    return docs.select((F.col("doc_id") % 97).alias("person_id"), F.col("doc_id").alias("visit_occurrence_id"), raw.alias("raw_text"), "text")


_WORDS = r"regexp_replace(text, '[^\p{L}\p{N}., ]', ' ', 'g')"
_ANSWER = f"""SELECT doc_id, text, doc_id % 5 AS k, {_WORDS} AS words,
  [{', '.join(f"'{s}'" for s in SAID)}][doc_id % 6 + 1] AS said, ['0.94', '0.88', '0.4', '0.5'][doc_id % 4 + 1] AS score FROM documents"""


@register(rf"""WITH a AS ({_ANSWER}), s AS (SELECT *, CASE said WHEN 'probable' THEN 'SUSPECTED_PROBABLE' WHEN 'Ruled-out' THEN 'CONFIRMED_NEGATIVE'
    WHEN 'TRUE' THEN 'CONFIRMED_POSITIVE' WHEN 'Definite' THEN 'CONFIRMED_POSITIVE' WHEN 'unknown' THEN 'INDETERMINATE_INSUFFICIENT_DATA' END AS st,
    trim(substr(words, 1, 40)) AS q FROM a), f AS (SELECT *, k <> 3 AND st IS NOT NULL AS ok FROM s)
  SELECT doc_id AS visit_occurrence_id, ok AS parsed, CASE WHEN ok THEN st ELSE 'INDETERMINATE_INSUFFICIENT_DATA' END AS phenotype_status,
    ok AND st IN ('CONFIRMED_POSITIVE', 'SUSPECTED_PROBABLE') AS condition_present,
    CASE WHEN ok THEN CAST(score AS DOUBLE) ELSE 0.0 END AS confidence_score,
    md5(CASE WHEN ok THEN CASE WHEN words = '' THEN 'The model gave a decision without a reason.' ELSE words END
        ELSE 'No readable answer came from the model.' END) AS rationale_md5,
    CASE WHEN ok AND length(q) >= 5 THEN q ELSE '' END AS quotes, CASE WHEN ok AND length(q) >= 5 THEN doc_id ELSE -1 END AS note_id FROM f""")
def response_ingest(spark: SparkSession, folder: str) -> DataFrame:
    parsed = responses.parse_responses(_answers(spark, folder).drop("text"), RUN_TS, "model")
    return parsed.select(
        "visit_occurrence_id", "parsed", "phenotype_status", "condition_present", "confidence_score",
        F.md5("clinical_rationale").alias("rationale_md5"), F.array_join("key_evidence.evidence_quote", "|").alias("quotes"),
        F.coalesce(F.get("key_evidence.note_id", F.lit(0)), F.lit(-1)).alias("note_id"))


VERDICTS = ("true, likely", "False", "1", "0", "[broken", '{"a": 2}')


@register(f"""WITH d AS ({sql.rule_decisions(views.notes_sql(True), views.NOTE_VISITS_SQL, rules.RULES["sepsis"])}),
  v AS (SELECT d.*, visit_occurrence_id % 7 AS k FROM d),
  w AS (SELECT *, CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 5 THEN true END AS verdict FROM v),
  f AS (SELECT *, condition_present OR coalesce(verdict, condition_present) AS final FROM w)
  SELECT visit_occurrence_id, CASE WHEN quotes = '' AND NOT condition_present THEN false ELSE final END AS condition_present,
    CASE WHEN quotes = '' AND NOT condition_present THEN phenotype_status WHEN final THEN 'CONFIRMED_POSITIVE' ELSE 'CONFIRMED_NEGATIVE' END AS phenotype_status,
    CASE WHEN quotes = '' AND NOT condition_present THEN confidence_score WHEN verdict IS NULL THEN 0.7 WHEN final THEN 0.95 ELSE 0.96 END::DOUBLE AS confidence_score,
    CASE WHEN quotes = '' AND NOT condition_present THEN 'hybrid:fast_rule_out' WHEN verdict IS NOT NULL THEN 'hybrid:m'
      WHEN k = 6 THEN 'hybrid:rules_only(no_response)' ELSE 'hybrid:rules_only(unreadable_response)' END AS inference_backend FROM f""")
def hybrid_arbitrate(spark: SparkSession, folder: str) -> DataFrame:
    """Rule decisions combined with short verdicts; one visit in seven has none."""
    visits = views.note_visits(spark, folder)
    decided = rules.rule_adjudicate(views.notes(spark, folder, clinical=True), visits, "Sepsis", RUN_TS)
    k = F.col("visit_occurrence_id") % 7
    said = visits.select("visit_occurrence_id", F.when(k < 6, pick(k, *VERDICTS)).alias("raw_text"))
    # Six of seven visits were answered.
    out = responses.hybrid_arbitrate(decided, visits, said.filter(F.col("raw_text").isNotNull()), "Sepsis", "m", RUN_TS)
    return out.select("visit_occurrence_id", "condition_present", "phenotype_status", "confidence_score", "inference_backend")


@register(rf"""WITH a AS ({_ANSWER}), q AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'never in the chart' ELSE trim(substr(words, 1, 40)) END AS quote FROM a),
  c AS (SELECT *, contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AND length(quote) >= 5 AS held FROM q),
  r AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'http_500' WHEN doc_id % 13 = 0 THEN 'model_mismatch' WHEN doc_id % 17 = 0 THEN 'not_finished' END AS why FROM c)
  SELECT doc_id AS visit_occurrence_id, CASE WHEN why IS NULL AND held THEN 'CONFIRMED_POSITIVE' ELSE 'INDETERMINATE_INSUFFICIENT_DATA' END AS phenotype_status,
    CASE WHEN why IS NULL AND held THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence_score,
    CASE WHEN why IS NULL THEN 'hybrid:m:required_llm' ELSE 'hybrid:llm_failed(' || why || ')' END AS inference_backend FROM r""")
def required_model(spark: SparkSession, folder: str) -> DataFrame:
    """The model decides; only verbatim quotes count; failures never fall back."""
    docs = views.spread(views.table(spark, folder, "documents").select("doc_id", "text"))
    d = F.col("doc_id")
    words = F.regexp_replace("text", r"[^\p{L}\p{N}., ]", " ")
    quote = F.when(d % 3 == 0, "never in the chart").otherwise(F.trim(F.substring(words, 1, 40)))
    content = F.concat(F.lit('{"phenotype_status": "positive", "clinical_rationale": "x", "confidence_score": 0.9, "key_evidence": [{"quote": "'), quote, F.lit('"}]}'))
    made = docs.select(
        d.alias("visit_occurrence_id"), F.when(d % 11 == 0, 500).otherwise(200).alias("http_status"),
        F.when(d % 13 == 0, "other").otherwise("m").alias("model"), F.when(d % 17 == 0, "length").otherwise("stop").alias("finish_reason"),
        content.alias("content"))
    chart = docs.select((d % 97).alias("person_id"), d.alias("visit_occurrence_id"), F.col("text").alias("notes_formatted_text"))
    out = responses.required_model_arbitrate(chart, made, "m", RUN_TS)
    return out.select("visit_occurrence_id", "phenotype_status", "confidence_score", "inference_backend")


@register(r"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN substr(text, 6, 40) ELSE 'zq xv never seen words' END AS quote FROM documents),
  s AS (SELECT doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS chart, regexp_replace(quote, '^\s+|\s+$', '', 'g') AS q0 FROM a),
  u AS (SELECT doc_id, chart, regexp_replace(lower(regexp_replace(trim(trim(trim(q0, '.'), '"'), ''''), '\s+', ' ', 'g')), '^\s+|\s+$', '', 'g') AS w FROM s),
  t AS (SELECT *, list_filter(regexp_extract_all(w, '[a-z0-9.]+'), lambda x: length(x) >= 3) AS words,
    list_distinct(regexp_extract_all(chart, '[a-z0-9.]+')) AS known FROM u)
  SELECT doc_id AS visit_occurrence_id, CASE WHEN chart = '' OR length(w) < 4 THEN 0 WHEN contains(chart, w) THEN 1 WHEN len(words) = 0 THEN 0
    WHEN len(list_filter(words, lambda x: list_contains(known, x))) / len(words) >= 0.75 THEN 1 ELSE 0 END AS quotes_kept FROM t""")
def ground_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Adjudications keep only the quotes their chart holds."""
    docs = views.spread(views.table(spark, folder, "documents").select("doc_id", "text"))
    d = F.col("doc_id")
    quote = F.when(d % 2 == 0, F.substring("text", 6, 40)).otherwise("zq xv never seen words")
    item = F.struct(d.alias("note_id"), F.lit("").alias("note_date"), quote.alias("evidence_quote"), F.lit("").alias("interpretation"))
    decided = docs.select(d.alias("visit_occurrence_id"), F.lit(True).alias("condition_present"), F.array(item).alias("key_evidence"))
    chart = docs.select(d.alias("visit_occurrence_id"), F.col("text").alias("notes_formatted_text"))
    return responses.ground_evidence(decided, chart).select("visit_occurrence_id", F.size("key_evidence").alias("quotes_kept"))


# ------------------------------------------------------------------ adjudication lists
def _adjudications(spark: SparkSession, folder: str) -> DataFrame:
    labels = views.table(spark, folder, "labels")
    docs = views.table(spark, folder, "documents").select("doc_id", "n_chars", "source")
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), fixed.POSITIVE).when(F.col("quality") == 1, fixed.PROBABLE).when(
        F.col("toxic") == 1, fixed.NEGATIVE).otherwise(fixed.INDETERMINATE)
    return labels.join(docs, "doc_id").select(
        (F.col("doc_id") % 97).alias("person_id"), F.col("doc_id").alias("visit_occurrence_id"), status.alias("phenotype_status"),
        status.isin(fixed.POSITIVE, fixed.PROBABLE).alias("condition_present"),
        ((F.col("n_chars") % 101) / 100).alias("confidence_score"),
        F.concat(F.lit("Length "), F.col("n_chars").cast("string"), F.lit(" from "), "source").alias("clinical_rationale"))


_ADJ = """SELECT doc_id % 97 AS person_id, doc_id AS visit_occurrence_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'CONFIRMED_POSITIVE'
  WHEN quality = 1 THEN 'SUSPECTED_PROBABLE' WHEN toxic = 1 THEN 'CONFIRMED_NEGATIVE' ELSE 'INDETERMINATE_INSUFFICIENT_DATA' END AS phenotype_status,
  quality = 1 AS condition_present, CAST(n_chars % 101 AS DOUBLE) / 100 AS confidence_score,
  'Length ' || n_chars || ' from ' || source AS clinical_rationale FROM labels JOIN documents USING (doc_id)"""


@register(f"""SELECT 9000000 + row_number() OVER (ORDER BY visit_occurrence_id) AS observation_id, person_id, 443454 AS observation_concept_id,
  confidence_score AS value_as_number, phenotype_status AS value_as_string, CASE phenotype_status WHEN 'CONFIRMED_POSITIVE' THEN 4181412
  WHEN 'SUSPECTED_PROBABLE' THEN 4181413 WHEN 'CONFIRMED_NEGATIVE' THEN 4188540 ELSE 45877994 END AS value_as_concept_id, visit_occurrence_id,
  '2026-01-31' AS observation_date, substr(clinical_rationale, 1, 250) AS qualifier_source_value FROM ({_ADJ})""")
def observation_export(spark: SparkSession, folder: str) -> DataFrame:
    rows = export.observations(_adjudications(spark, folder), "Acute Ischemic Stroke", RUN_TS)
    return rows.select("observation_id", "person_id", "observation_concept_id", "value_as_number", "value_as_string",
                       "value_as_concept_id", "visit_occurrence_id", "observation_date", "qualifier_source_value")


@register(f"""SELECT count(*) AS total, count(*) FILTER (condition_present) AS positive, count(*) FILTER (NOT condition_present) AS negative,
  round(100.0 * count(*) FILTER (condition_present) / count(*), 1)::DOUBLE AS positive_pct, round(avg(confidence_score), 3) AS mean_confidence FROM ({_ADJ})""")
def cohort_figures(spark: SparkSession, folder: str) -> DataFrame:
    return export.cohort_figures(_adjudications(spark, folder))


@register(f"SELECT visit_occurrence_id FROM ({_ADJ}) WHERE visit_occurrence_id NOT IN (SELECT conv_id FROM conversations)")
def review_queue(spark: SparkSession, folder: str) -> DataFrame:
    signed = views.table(spark, folder, "conversations").select(F.col("conv_id").alias("visit_occurrence_id"))
    return export.review_queue(_adjudications(spark, folder), signed).select("visit_occurrence_id")


@register(f"""SELECT visit_occurrence_id FROM ({_ADJ}) WHERE phenotype_status = 'CONFIRMED_POSITIVE'
  AND (contains(CAST(visit_occurrence_id AS VARCHAR), 'src1') OR contains(lower(clinical_rationale), 'src1'))""")
def result_search(spark: SparkSession, folder: str) -> DataFrame:
    return export.search_results(_adjudications(spark, folder), fixed.POSITIVE, " SRC1 ").select("visit_occurrence_id")


@register("SELECT o_orderkey AS visit_occurrence_id FROM orders ORDER BY o_orderkey LIMIT 5")
def quick_sample(spark: SparkSession, folder: str) -> DataFrame:
    visits = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("visit_occurrence_id"))
    return export.quick_sample(visits)


@register("""SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id FROM orders
  WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    visits = views.table(spark, folder, "orders").select(F.col("o_orderkey").alias("visit_occurrence_id"), F.col("o_custkey").alias("person_id"))
    done = views.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("visit_occurrence_id"))
    return incremental.pending(visits, done)


# ------------------------------------------------------------------ audit log
DECISIONS = ("Override: Mark Positive", "Override: Mark Negative", "Agree", "")
STATUSES = ("CONFIRMED_POSITIVE", "CONFIRMED_NEGATIVE", "")


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    return views.table(spark, folder, "events").select(
        k.alias("visit_occurrence_id"), F.col("user_id").alias("person_id"), pick(k, *STATUSES).alias("llm_status"),
        pick(F.floor(k / 3), *DECISIONS).alias("human_decision"), F.when(k % 5 == 0, k % 2 == 0).alias("human_positive"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))


_AUDIT = """SELECT event_id, user_id, s AS llm_status, nullif(d, '') AS human_decision, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  CASE WHEN event_id % 5 = 0 THEN event_id % 2 = 0 WHEN contains(d, 'Override') THEN contains(d, 'Positive') ELSE contains(s, 'POSITIVE') END AS h,
  contains(s, 'POSITIVE') AS m FROM (SELECT *, ['CONFIRMED_POSITIVE', 'CONFIRMED_NEGATIVE', ''][event_id % 3 + 1] AS s,
  ['Override: Mark Positive', 'Override: Mark Negative', 'Agree', ''][event_id // 3 % 4 + 1] AS d FROM events)"""


@register(f"SELECT event_id AS visit_occurrence_id, llm_status, human_decision, h AS human_positive, m AS llm_positive, 'physician_01' AS reviewer_id FROM ({_AUDIT})")
def audit_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return export.normalize_audit(_audit(spark, folder)).select(
        "visit_occurrence_id", "llm_status", "human_decision", "human_positive", "llm_positive", "reviewer_id")


@register(sql.agreement(f"SELECT {sql.COUNTS} FROM ({_AUDIT})"))
def audit_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return export.audit_agreement(_audit(spark, folder))


@register(f"SELECT event_id AS visit_occurrence_id, timestamp FROM ({_AUDIT}) ORDER BY timestamp DESC, event_id DESC LIMIT 12")
def recent_audit(spark: SparkSession, folder: str) -> DataFrame:
    return export.recent_audit(export.normalize_audit(_audit(spark, folder))).select("visit_occurrence_id", "timestamp")


# ------------------------------------------------------------------ quality
@register("""WITH n AS (SELECT doc_id // 2 AS row_id, CASE WHEN doc_id % 9 = 0 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS hadm,
    CASE WHEN doc_id % 14 = 0 THEN ' ' ELSE text END AS text FROM documents),
  l AS (SELECT ['sosy', 'dsyn', 'other', ''][doc_id % 4 + 1] AS sem, ['yes', 'no', 'maybe'][doc_id % 3 + 1] AS det,
    ['yes', '-'][doc_id % 2 + 1] AS enc, ['no', '-', 'unsure', 'perhaps'][doc_id % 4 + 1] AS neg FROM labels)
  SELECT 'note_hadm_id_not_integer' AS rule, count(*) AS violations FROM n WHERE TRY_CAST(hadm AS DOUBLE) IS NULL HAVING count(*) > 0
  UNION ALL SELECT 'note_row_id_repeated', count(*) FROM (SELECT row_id FROM n GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'note_text_blank', count(*) FROM n WHERE NOT regexp_matches(text, '\\S') HAVING count(*) > 0
  UNION ALL SELECT 'label_semtypes_domain', count(*) FROM l WHERE sem = 'other' HAVING count(*) > 0
  UNION ALL SELECT 'label_detection_domain', count(*) FROM l WHERE det = 'maybe' HAVING count(*) > 0
  UNION ALL SELECT 'label_negation_domain', count(*) FROM l WHERE neg = 'perhaps' HAVING count(*) > 0
  UNION ALL SELECT 'label_undetected_not_dash', count(*) FROM l WHERE det = 'no' AND (enc <> '-' OR neg <> '-') HAVING count(*) > 0""")
def quality_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Violations per rule of damaged notes and labels."""
    d = F.col("doc_id")
    notes = views.table(spark, folder, "documents").select(
        F.floor(d / 2).alias("row_id"), F.when(d % 9 == 0, F.concat(F.lit("x"), d.cast("string"))).otherwise(d.cast("string")).alias("hadm_id"),
        d.alias("subject_id"), F.when(d % 14 == 0, " ").otherwise(F.col("text")).alias("text"))
    labels = views.table(spark, folder, "labels").select(
        d.alias("row_id"), F.lit("t").alias("trigger_word"), F.lit("c").alias("concept"), pick(d, "sosy", "dsyn", "other", "").alias("semtypes"),
        F.lit(0).alias("start"), F.lit(1).alias("end"), pick(d, "yes", "no", "maybe").alias("detection"), pick(d, "yes", "-").alias("encounter"),
        pick(d, "no", "-", "unsure", "perhaps").alias("negation"))
    broken = quality.note_violations(notes).unionByName(quality.label_domain_violations(quality.clean_labels(labels)))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@register(r"""SELECT p_partkey, list_aggregate(list_transform(list_filter(string_split(raw, '|'), lambda c: contains(c, ',')),
    lambda c: trim(string_split(c, ',')[1]) || '=' || trim(regexp_replace(regexp_replace(substr(c, strpos(c, ',') + 1), '</?[A-Za-z][^>]*>', ' ', 'g'), '\s+', ' ', 'g'))),
    'string_agg', ';') AS choices FROM (SELECT p_partkey, '1, <b>' || p_name || '</b> | 2 , ' || p_brand || ', big | none | 9,' || p_type AS raw FROM part)""")
def parse_choices(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit("1, <b>"), "p_name", F.lit("</b> | 2 , "), "p_brand", F.lit(", big | none | 9,"), "p_type")
    pairs = tables.parse_choices(raw)
    return views.table(spark, folder, "part").select(
        "p_partkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["code"], F.lit("="), p["label"])), ";").alias("choices"))


# ------------------------------------------------------------------ survey
@register("""WITH r AS (SELECT o_orderkey + 2 AS source_row, o_orderpriority AS inst, CAST(o_custkey AS VARCHAR) AS rec, CAST(o_orderkey % 500 AS VARCHAR) AS vid FROM orders),
  p AS (SELECT inst, rec, count(*) AS stays, row_number() OVER (ORDER BY min(source_row)) AS person FROM r GROUP BY 1, 2),
  v AS (SELECT inst, vid, count(DISTINCT rec) > 1 AS reused FROM r GROUP BY 1, 2)
  SELECT printf('S%02d-P%02d', source_row, t) AS case_id, stays AS linked_stay_count, reused AS visit_id_reused, person AS person_id
  FROM r JOIN p USING (inst, rec) JOIN v USING (inst, vid), range(1, 10) g(t)""")
def patient_linkage(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 2).alias("source_row"), F.col("o_orderpriority").alias("institution_v3"),
        F.col("o_custkey").cast("string").alias("record_id"), (F.col("o_orderkey") % 500).cast("string").alias("vid"))
    return survey.linked_cases(rows).select("case_id", "linked_stay_count", "visit_id_reused", "person_id")


SURVEY_FIELDS = (
    ("sepsis_ync_v3", "radio", "Sepsis?", "1, Yes | 2, No"), ("sep1_v3", "checkbox", "SIRS", "1, Temperature | 2, Heart rate"),
    ("sep3_v3", "text", "Culture", ""), ("sep4_v3", "yesno", "Antibiotics", ""), ("sep7_v3", "text", "Score", ""),
    ("aki_ync_v3", "radio", "AKI?", "1, Yes"), ("aki1_v3", "yesno", "Creatinine rise", ""),
    ("shock_ync_v3", "radio", "Shock?", "1, Yes"),
    ("shock2_v4_sep", "radio", "Septic shock", "1, Description of septic shock | 2, b | 3, c | 4, 1 and 2 | 5, All of above"),
    ("did_the_patient_visit_have", "radio", "Arrest", "1, Yes"), ("ca_setting", "text", "Setting", ""), ("mortality_ca", "radio", "Died", "1, Yes"),
)


def _survey(spark: SparkSession, folder: str) -> survey.SurveyCases:
    """customer as survey rows; a segment and nation make a patient."""
    k = F.col("c_custkey")
    rows = views.spread(views.table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")).select(
        (k + 2).alias("source_row"), F.col("c_mktsegment").alias("institution_v3"), F.col("c_nationkey").cast("string").alias("record_id"),
        k.cast("string").alias("vid"), pick(k, "1", "2").alias("sepsis_ync_v3"), pick(k, "1", "0").alias("sep1_v3___1"),
        pick(k, "1", "1", "").alias("sep1_v3___2"), pick(k, "sepsis", "", "NO").alias("sep3_v3"), pick(k, "1", "0", "").alias("sep4_v3"),
        pick(k, "3", "", "1").alias("sep7_v3"), pick(k, "0", "1", "", "").alias("aki1_v3"), pick(k, "", "4", "5", "2").alias("shock2_v4_sep"),
        pick(k, "", "IHCA").alias("ca_setting"))
    spec = spark.createDataFrame(
        [(n, *row) for n, row in enumerate(SURVEY_FIELDS)],
        "field_order long, `Variable / Field Name` string, `Field Type` string, `Field Label` string, `Choices, Calculations, OR Slider Labels` string")
    return survey.prepare_cases(rows, tables.instrument(spec))


OBSERVATIONS_SQL = """WITH c AS (SELECT c_custkey AS k, c_custkey + 2 AS source_row, c_mktsegment AS inst, CAST(c_nationkey AS VARCHAR) AS rec FROM customer),
  o AS (SELECT c.*, f.* FROM c, LATERAL (VALUES
    ('sep1_v3', 1, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 < 2 THEN 'Temperature; Heart rate' ELSE 'Temperature' END WHEN k % 3 < 2 THEN 'Heart rate' END),
    ('sep3_v3', 2, ['sepsis', NULL, 'NO'][k % 3 + 1]), ('sep4_v3', 3, ['Yes', 'No', NULL][k % 3 + 1]), ('sep7_v3', 4, ['3', NULL, '1'][k % 3 + 1]),
    ('aki1_v3', 6, ['No', 'Yes', NULL, NULL][k % 4 + 1]),
    ('shock2_v4_sep', 8, [NULL, '1 and 2 [dictionary expansion: 1. Description of septic shock; 2. b]',
      'All of above [dictionary expansion: 1. Description of septic shock; 2. b; 3. c]', 'b'][k % 4 + 1]),
    ('ca_setting', 10, [NULL, 'IHCA'][k % 2 + 1])) f(field, ord, response) WHERE response IS NOT NULL),
  t AS (SELECT *, unnest(CASE WHEN field LIKE 'sep%' THEN [1] WHEN field LIKE 'aki%' THEN [1, 3] WHEN field LIKE 'shock%' THEN [1, 7] ELSE [9] END) AS target FROM o)
  SELECT inst AS institution_v3, rec AS record_id, target, source_row, field, response,
    row_number() OVER (PARTITION BY inst, rec, target ORDER BY source_row, CASE WHEN target = 1 AND field NOT LIKE 'sep%' THEN 1 ELSE 0 END, ord) AS observation FROM t"""


@register(OBSERVATIONS_SQL)
def survey_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Masked observations, numbered per patient and target."""
    return _survey(spark, folder).observations.select(
        "institution_v3", "record_id", "target", "source_row", "field", "response", "observation")


@register("""WITH c AS (SELECT c_custkey AS k FROM customer), f AS (SELECT k, k % 3 = 0 AS said_sepsis, k % 4 IN (1, 2) AS septic,
    k % 3 = 0 AS infected, k % 3 = 0 AS scored, k % 4 = 1 AS renal, (k % 2 = 0 OR k % 3 < 2) AS signs FROM c)
  SELECT printf('S%02d-P%02d', k + 2, target) AS case_id, "check" FROM f, LATERAL (
    SELECT 1 AS target, 'sepsis_unsupported' AS "check" WHERE NOT (said_sepsis OR septic OR (infected AND scored) OR (infected AND renal))
    UNION ALL SELECT 1, 'sepsis_only_probable' WHERE NOT (said_sepsis OR septic)
    UNION ALL SELECT 1, 'answer_without_quote'
    UNION ALL SELECT 1, 'signs_called_missing' WHERE signs
    UNION ALL SELECT 3, 'answer_without_quote' UNION ALL SELECT 3, 'no_current_observations' WHERE k % 4 > 1
    UNION ALL SELECT 7, 'answer_without_quote' UNION ALL SELECT 7, 'no_current_observations' WHERE k % 4 = 0
    UNION ALL SELECT 7, 'shock_elements_missing' WHERE NOT septic)""")
def survey_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of unquoted positive answers for sepsis, kidney injury and shock."""
    prepared = _survey(spark, folder)
    said = prepared.cases.filter(F.col("target").isin(1, 3, 7)).select(
        "case_id", F.lit(fixed.POSITIVE).alias("phenotype_status"), F.lit("SIRS was not documented").alias("clinical_rationale"),
        F.array().cast("array<string>").alias("primary_criteria_met"), F.array().cast(rules.EVIDENCE).alias("key_evidence"))
    return survey.audit_results(said, prepared).select("case_id", "check")


# ------------------------------------------------------------------ repair rounds
REQUIRED = "hybrid:model:required_llm"


def _round_answers(prepared: survey.SurveyCases, attempt: int) -> DataFrame:
    """Answers for sepsis, kidney injury and shock: unquoted at first, then half quote a line, at last a fifth withdraw."""
    first = survey.current_observations(prepared).groupBy("case_id").agg(
        F.min(F.struct("observation", survey.observation_line(F.lit(survey.CURRENT)).alias("line")))["line"].alias("line"))
    rows = prepared.cases.filter(F.col("target").isin(1, 3, 7)).join(first, "case_id", "left")
    k = F.col("source_row") - 2
    withdrawn = F.lit(attempt == 3) & (k % 5 == 0)
    wrong = "[O001] nothing (current stay): at all"
    quote = F.when(F.lit(attempt == 1) | withdrawn, None).when(F.lit(attempt == 2) & (k % 2 == 0), F.col("line")).otherwise(wrong)
    status = F.when(withdrawn, fixed.INDETERMINATE).otherwise(fixed.POSITIVE)
    item = F.struct(F.lit(None).cast("bigint").alias("note_id"), F.lit("").alias("note_date"), quote.alias("evidence_quote"), F.lit("x").alias("interpretation"))
    return rows.select(
        "case_id", status.alias("phenotype_status"), (status == fixed.POSITIVE).alias("condition_present"), F.lit(0.9).alias("confidence_score"),
        F.lit("SIRS was not documented" if attempt == 1 else "Reported").alias("clinical_rationale"), F.array().cast("array<string>").alias("primary_criteria_met"),
        F.when(quote.isNull(), F.array()).otherwise(F.array(item)).cast(rules.EVIDENCE).alias("key_evidence"), F.lit(REQUIRED).alias("inference_backend"))


_ROUND_CHECKS = """SELECT k, target, attempt, st, CASE WHEN p AND NOT own THEN 1 ELSE 0 END + CASE WHEN q = 'wrong' THEN 1 ELSE 0 END + CASE WHEN p AND q = 'none' THEN 1 ELSE 0 END
    + CASE target WHEN 1 THEN CASE WHEN p AND NOT (said OR k % 3 = 0) THEN 1 ELSE 0 END + CASE WHEN p AND NOT said THEN 1 ELSE 0 END + CASE WHEN attempt = 1 AND (k % 2 = 0 OR k % 3 < 2) THEN 1 ELSE 0 END
      WHEN 3 THEN CASE WHEN k % 4 = 1 AND NOT p THEN 1 ELSE 0 END ELSE CASE WHEN p AND k % 4 NOT IN (1, 2) THEN 1 ELSE 0 END END AS wrong
  FROM (SELECT *, st = 'CONFIRMED_POSITIVE' AS p, k % 3 = 0 OR k % 4 IN (1, 2) AS said, CASE WHEN attempt = 1 OR st <> 'CONFIRMED_POSITIVE' THEN 'none'
      WHEN attempt = 2 AND k % 2 = 0 THEN CASE WHEN own THEN 'line' ELSE 'none' END ELSE 'wrong' END AS q
    FROM (SELECT *, CASE WHEN attempt = 3 AND k % 5 = 0 THEN 'INDETERMINATE_INSUFFICIENT_DATA' ELSE 'CONFIRMED_POSITIVE' END AS st,
        CASE target WHEN 1 THEN true WHEN 3 THEN k % 4 < 2 ELSE k % 4 > 0 END AS own
      FROM (SELECT c_custkey AS k FROM customer), (VALUES (1), (3), (7)) t(target), (VALUES (1), (2), (3)) a(attempt)))"""


@register(f"""WITH c AS ({_ROUND_CHECKS}), e AS (SELECT k, target, coalesce(min(attempt) FILTER (wrong = 0), 3) AS last, count(*) FILTER (wrong = 0) > 0 AS clean FROM c GROUP BY 1, 2)
  SELECT printf('S%02d-P%02d', k + 2, target) AS case_id, CASE WHEN any_value(clean) THEN 'passed' ELSE 'held' END AS state, any_value(last) AS attempt,
    CASE WHEN any_value(clean) THEN arg_max(st, attempt) ELSE 'INDETERMINATE_INSUFFICIENT_DATA' END AS phenotype_status, CAST(sum(wrong) AS BIGINT) AS violations,
    '{REQUIRED}' || CASE WHEN any_value(clean) THEN '' ELSE ':quality_hold' END AS inference_backend
  FROM c JOIN e USING (k, target) WHERE attempt <= last GROUP BY k, target""")
def repair_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Three rounds of answers with quotes: what passed, what is held, and how much was wrong on the way."""
    prepared = _survey(spark, folder)
    prompts = prepared.cases.filter(F.col("target").isin(1, 3, 7)).select("case_id", F.lit("Answer from the numbered lines.").alias("prompt"))

    def answer(asked: DataFrame, attempt: int) -> DataFrame:
        return _round_answers(prepared, attempt).join(asked.select("case_id"), "case_id", "left_semi")

    out = repair.repair(prepared, prompts, answer, f"{shared_folder(spark)}/repair-{uuid.uuid4().hex}", RUN_TS)
    wrong = out.violations.groupBy("case_id").agg(F.count(F.lit(1)).alias("violations"))
    return out.results.join(wrong, "case_id", "left").select(
        "case_id", "state", "attempt", "phenotype_status", F.coalesce("violations", F.lit(0)).alias("violations"), "inference_backend")


@register(f"""WITH o AS ({OBSERVATIONS_SQL}), f AS (SELECT *, row_number() OVER (PARTITION BY source_row, target ORDER BY observation) AS place FROM o WHERE target IN (1, 3, 7))
  SELECT printf('S%02d-P%02d', source_row, target) AS case_id, printf('[O%03d] ', observation) || field || ' (current stay): ' || response AS quote, field
  FROM f WHERE place = 1 AND (source_row - 2) % 2 = 0""")
def verified_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of model answers that repeat an observation of the patient."""
    prepared = _survey(spark, folder)
    return survey.verified_evidence(_round_answers(prepared, 2), prepared).select("case_id", "quote", "field")


@register(f"""WITH o AS ({OBSERVATIONS_SQL}), s AS (SELECT inst, rec, count(*) AS stays FROM (SELECT c_mktsegment AS inst, CAST(c_nationkey AS VARCHAR) AS rec FROM customer) GROUP BY 1, 2),
  x AS (SELECT institution_v3 AS inst, record_id AS rec, target, bool_or(contains(response, 'dictionary expansion')) AS expanded FROM o GROUP BY 1, 2, 3),
  f AS (SELECT *, row_number() OVER (PARTITION BY source_row, target ORDER BY observation) AS place FROM o),
  c AS (SELECT c_custkey AS k, c_custkey + 2 AS source_row, c_mktsegment AS inst, CAST(c_nationkey AS VARCHAR) AS rec, target, name FROM customer, (VALUES (1, 'Sepsis'), (3, 'Acute kidney injury'), (7, 'Shock (all cause)')) t(target, name))
  SELECT printf('S%02d-P%02d', k + 2, c.target) AS review_id, inst AS institution, rec AS patient, CAST(k AS VARCHAR) AS visit, name AS target, 'CONFIRMED_POSITIVE' AS suggestion,
    concat_ws(chr(10), 'Based on survey answers alone; compare with the chart.', CASE WHEN stays > 1 THEN 'Answers of several stays are shown; their order is not known.' END,
      CASE WHEN (c.target = 3 AND k % 4 > 1) OR (c.target = 7 AND k % 4 = 0) THEN 'Nothing was answered for this stay; that is not a no.' END,
      CASE WHEN coalesce(expanded, false) THEN 'Some texts are choice labels, not words of the chart.' END,
      CASE WHEN c.target = 1 AND k % 4 = 1 THEN 'Kidney injury was counted; check when and why it began.' END) AS flags,
    CASE WHEN k % 2 = 0 AND f.field IS NOT NULL THEN printf('[O%03d] ', observation) || f.field || ' (current stay): ' || response ELSE '' END AS evidence
  FROM c JOIN s USING (inst, rec) LEFT JOIN x USING (inst, rec, target) LEFT JOIN (SELECT * FROM f WHERE place = 1) f ON f.source_row = c.source_row AND f.target = c.target""")
def review_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """The reviewer's sheet over quoted answers: one row a case, flags and evidence."""
    prepared = _survey(spark, folder)
    sheet = survey.review_sheet(_round_answers(prepared, 2), prepared)
    return sheet.select(
        F.col("Review ID").alias("review_id"), F.col("Institution").alias("institution"), F.col("Assumed patient ID").alias("patient"), F.col("Visit ID").alias("visit"),
        F.col("Target").alias("target"), F.col("AI suggestion").alias("suggestion"), F.col("Review flags").alias("flags"), F.col("Extracted evidence").alias("evidence"))
