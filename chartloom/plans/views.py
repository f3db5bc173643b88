"""The driver's tables in the shapes the operators read.

Each view has a Spark form and the same definition as SQL text, so a query and
its check start from the same rows. Every view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions.text import once


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, parts_a_core: int = 1) -> DataFrame:
    """Use all cores for work that is heavy per row. The scan's own parts are kept once there are enough of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores * parts_a_core else df


def hours_after(start: str, hours: Column) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hours.cast("int"))


# ------------------------------------------------------------------ notes
def _clinical(text: Column) -> Column:
    for word, phrase in CLINICAL_WORDS:
        text = F.replace(text, F.lit(word), F.lit(phrase))
    return text


# Common words of the invented prose and the clinical phrases put in their place.
CLINICAL_WORDS = (
    (" with ", " no evidence of sepsis. "),
    (" was ", " septic shock "),
    (" le ", " bacteremia "),
    (" und ", " rule out septic "),
    (" that ", " acute ischemic stroke "),
    (" for ", " history of prior stroke "),
    (" que ", " r/o cva "),
    (" on ", " acute kidney injury "),
    (" by ", " no aki "),
    (" die ", " respiratory failure "),
    (" is ", " pulmonary embolism "),
    (" and ", " denies "),
    (" de ", " fever "),
    (" of ", " afebrile "),
)


def clinical_sql(column: str = "text") -> str:
    for word, phrase in CLINICAL_WORDS:
        column = f"replace({column}, '{word}', '{phrase}')"
    return column


def notes(spark: SparkSession, folder: str, clinical: bool = False, parts_a_core: int = 1) -> DataFrame:
    """documents as NOTE: five notes per visit."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "source", "text"), parts_a_core)
    if clinical:
        docs = once(docs.withColumnRenamed("text", "prose"), "text", _clinical(F.col("prose")))
    visit = F.floor(F.col("doc_id") / 5)
    return docs.select(
        F.col("doc_id").alias("note_id"),
        (visit % 97).alias("person_id"),
        visit.alias("visit_occurrence_id"),
        hours_after("2026-01-01", F.col("doc_id") * 37 % 240).alias("note_datetime"),
        F.col("source").alias("note_title"),
        F.col("text").alias("note_text"),
    )


def notes_sql(clinical: bool = False) -> str:
    text = clinical_sql() if clinical else "text"
    return f"""SELECT doc_id AS note_id, doc_id // 5 % 97 AS person_id, doc_id // 5 AS visit_occurrence_id,
      TIMESTAMP '2026-01-01' + to_hours(CAST(doc_id * 37 % 240 AS INTEGER)) AS note_datetime,
      source AS note_title, {text} AS note_text FROM documents"""


PANEL_TITLES = ("Discharge Summary", "H&P", "Progress", "Nursing", "Operative report")
PANELS = ("discharge_summary", "hp", "progress_consult", "nursing", "procedure_operative")


def cohort_notes(spark: SparkSession, folder: str, clinical: bool = True) -> DataFrame:
    """All documents as panel notes of the users' visits."""
    users = table(spark, folder, "events").agg(F.max("user_id") + 1).scalar()
    title = F.element_at(F.array(*(F.lit(t) for t in PANEL_TITLES)), (F.col("note_id") % len(PANEL_TITLES) + 1).cast("int"))
    # A few parts a core may hold but a few row groups, and the phrases take far longer than the dealing out.
    return notes(spark, folder, clinical, 4 if clinical else 1).withColumns({
        "note_title": title, "visit_occurrence_id": F.col("visit_occurrence_id") % users})


def scrubbed_sql(text: str) -> str:
    for shape in fixed.DATE_SHAPES:
        text = f"regexp_replace({text}, '{shape}', '{fixed.DATE_REDACTED}', 'g')"
    return text


# Text without dates, as it is after cleaning.
COHORT_NOTES_SQL = f"""SELECT doc_id AS note_id, doc_id // 5 % (SELECT max(user_id) + 1 FROM events) AS visit_occurrence_id,
  TIMESTAMP '2026-01-01' + to_hours(CAST(doc_id * 37 % 240 AS INTEGER)) AS note_datetime,
  [{', '.join(f"'{p}'" for p in PANELS)}][doc_id % 5 + 1] AS panel, [{', '.join(f"'{t}'" for t in PANEL_TITLES)}][doc_id % 5 + 1] AS title,
  {scrubbed_sql(r"regexp_replace(" + clinical_sql() + r", '^\s+|\s+$', '', 'g')")} AS note_text FROM documents WHERE regexp_matches(text, '\\S')"""


def note_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits of the notes and as many visits without notes."""
    docs = table(spark, folder, "documents").select("doc_id")
    return docs.select(
        F.col("doc_id").alias("visit_occurrence_id"), (F.col("doc_id") % 97).alias("person_id"),
        F.lit("2026-01-01").alias("visit_start_date"), F.lit("2026-01-11").alias("visit_end_date"),
    )


NOTE_VISITS_SQL = """SELECT doc_id AS visit_occurrence_id, doc_id % 97 AS person_id, '2026-01-01' AS visit_start_date,
  '2026-01-11' AS visit_end_date FROM documents"""


def span_notes(spark: SparkSession, folder: str) -> DataFrame:
    """documents in the span dialect, with clinical phrases."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    visit = F.floor(F.col("doc_id") / 5)
    return once(docs, "note", _clinical(F.col("text"))).select(
        F.col("doc_id").alias("row_id"), visit.alias("hadm_id"), (visit % 97).alias("subject_id"), F.col("note").alias("text"),
    )


def span_notes_sql() -> str:
    return f"""SELECT doc_id AS row_id, doc_id // 5 AS hadm_id, doc_id // 5 % 97 AS subject_id,
      {clinical_sql()} AS text FROM documents"""


# ------------------------------------------------------------------ structured tables
EVENT_NAME = {
    "view": ("HR", "Platelets"), "error": ("Lactate", "Creatinine"), "signup": ("Temp", "WBC"),
    "purchase": ("RR", "Bilirubin"), "click": ("GCS", "MAP"),
}


def measurements(spark: SparkSession, folder: str) -> DataFrame:
    """events as MEASUREMENT, one visit per user."""
    name = F.lit(None).cast("string")
    for kind, (even, odd) in EVENT_NAME.items():
        name = F.when(F.col("event_type") == kind, F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)).otherwise(name)
    events = spread(table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    return events.select(
        F.col("user_id").cast("string").alias("visit_occurrence_id"),
        F.col("event_id").cast("string").alias("measurement_id"),
        F.col("event_id").alias("row_order"),
        F.date_trunc("MINUTE", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("measurement_datetime"),
        name.alias("measurement_name"),
        F.when(name.isin("Lactate", "Creatinine", "Bilirubin"), F.col("value") / 16)
        .when(name == "GCS", F.lit(3.0) + F.floor(F.col("value")) % 13).otherwise(F.col("value")).alias("value_as_number"),
        F.lit(None).cast("string").alias("value_as_string"),
        F.lit("k").alias("unit"),
    )


def _event_name_sql() -> str:
    cases = " ".join(
        f"WHEN '{kind}' THEN CASE WHEN event_id % 2 = 0 THEN '{even}' ELSE '{odd}' END"
        for kind, (even, odd) in EVENT_NAME.items()
    )
    return f"CASE event_type {cases} END"


MEASUREMENTS_SQL = f"""SELECT vid, event_id, moment, name,
  CASE WHEN name IN ('Lactate', 'Creatinine', 'Bilirubin') THEN value / 16
       WHEN name = 'GCS' THEN 3.0 + CAST(floor(value) AS BIGINT) % 13 ELSE value END AS raw
  FROM (SELECT CAST(user_id AS VARCHAR) AS vid, event_id, date_trunc('minute', ts) AS moment, value,
        {_event_name_sql()} AS name FROM events)"""

# The same rows with the unit rules applied; the unit is "k".
LEVELS_SQL = f"""SELECT vid, event_id, moment, CAST(moment AS DATE) AS dated, lower(name) AS analyte,
  CASE WHEN name = 'Temp' AND raw > 45 THEN (raw - 32) * 5 / 9
       WHEN name = 'WBC' AND raw > 150 THEN raw / 1000 ELSE raw END AS level
  FROM ({MEASUREMENTS_SQL})"""


def user_visits(spark: SparkSession, folder: str) -> DataFrame:
    """One visit per user; admitted ten days into January, at noon."""
    return table(spark, folder, "events").select("user_id").distinct().select(
        F.col("user_id").cast("string").alias("visit_occurrence_id"), F.col("user_id").alias("person_id"),
        F.lit("2024-01-10 12:00:00").alias("icu_admit_datetime"),
    )


def user_of_order(spark: SparkSession, folder: str) -> Column:
    """The user an order belongs to: users are numbered from 0 without gaps at the scales of the driver."""
    users = table(spark, folder, "events").agg(F.max("user_id") + 1).scalar()
    return (F.col("l_orderkey") % users).cast("string")


USER_OF_ORDER = "CAST(l_orderkey % (SELECT max(user_id) + 1 FROM events) AS VARCHAR)"


def _lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *columns))


def order_drugs(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as DRUG EXPOSURE in January; every order belongs to one of the users."""
    start = hours_after("2024-01-01", (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 720)
    return _lines(spark, folder, "l_partkey", "l_quantity", "l_returnflag", "l_tax").select(
        user_of_order(spark, folder).alias("visit_occurrence_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("drug_exposure_id"),
        start.alias("drug_start_datetime"),
        (start + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("drug_end_datetime"),
        F.when(F.col("l_returnflag") == "R", "Vancomycin").when(F.col("l_returnflag") == "A", "Cefepime")
        .otherwise("Norepinephrine").alias("drug_name"),
        F.lit("IV").alias("route"),
        F.col("l_tax").cast("string").alias("dose_rate"),
        F.lit(None).cast("string").alias("drug_class"),
    )


DRUGS_SQL = f"""SELECT {USER_OF_ORDER} AS vid, l_returnflag AS flag, l_tax AS rate,
  TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey * 7 + l_linenumber * 131) % 720 AS INTEGER)) AS s,
  TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey * 7 + l_linenumber * 131) % 720 AS INTEGER))
    + to_hours(CAST(l_quantity AS INTEGER)) AS e, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS ref FROM lineitem"""


def part_cultures(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as CULTURE: the source and organism follow the part number."""
    organism = F.element_at(
        F.array(*(F.lit(o) for o in ORGANISMS)), (F.col("l_partkey") % len(ORGANISMS) + 1).cast("int")
    )
    return _lines(spark, folder, "l_partkey", "l_linestatus", "l_returnflag").select(
        user_of_order(spark, folder).alias("visit_occurrence_id"),
        F.col("l_partkey").cast("string").alias("culture_id"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 8 + F.col("l_partkey") % 4 * 2
         + (F.col("l_linestatus") == "O").cast("int")).alias("row_order"),
        hours_after("2024-01-01", (F.col("l_orderkey") * 11 + F.col("l_linenumber") * 29) % 720).alias("collection_datetime"),
        F.when(F.col("l_linestatus") == "O", "Blood").otherwise("Urine").alias("source"),
        organism.alias("organism"),
        F.when(F.col("l_returnflag") == "A", "negative").otherwise("(+)").alias("result"),
    )


ORGANISMS = ("Escherichia coli", "", "No growth", "Klebsiella")
CULTURES_SQL = f"""SELECT {USER_OF_ORDER} AS vid, (l_orderkey * 10 + l_linenumber) * 8 + l_partkey % 4 * 2 + CAST(l_linestatus = 'O' AS INTEGER) AS place,
  TIMESTAMP '2024-01-01' + to_hours(CAST((l_orderkey * 11 + l_linenumber * 29) % 720 AS INTEGER)) AS moment,
  CASE WHEN l_linestatus = 'O' THEN 'Blood' ELSE 'Urine' END AS source,
  ['Escherichia coli', '', 'No growth', 'Klebsiella'][l_partkey % 4 + 1] AS organism,
  CASE WHEN l_returnflag = 'A' THEN 'negative' ELSE '(+)' END AS result, CAST(l_partkey AS VARCHAR) AS ref FROM lineitem"""


def supplier_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as treatment intervals of a supplier, over several years."""
    return _lines(spark, folder, "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag").select(
        F.col("l_suppkey").alias("vid"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("start_time"),
        (F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("l_quantity").cast("int"))).alias("end_time"),
        (F.col("l_returnflag") == "R").alias("is_trough"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ref"),
    )


INTERVALS_SQL = """SELECT l_suppkey AS vid, l_shipdate AS s, l_shipdate + to_hours(CAST(l_quantity AS INTEGER)) AS e,
  l_returnflag = 'R' AS trough, printf('%d-%d', l_orderkey, l_linenumber) AS ref FROM lineitem"""


# ------------------------------------------------------------------ survey rows
def human_rows(spark: SparkSession, folder: str) -> DataFrame:
    """orders as survey rows filled in by a person."""
    orders = spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    return _survey(orders.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("a"),
        F.floor(F.col("o_totalprice") / 10000).alias("b"), F.lit(0).cast("bigint").alias("shift"),
    ))


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders seen in lineitem as survey rows filled in by a model."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.max("l_linenumber").cast("bigint").alias("top"))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.floor(F.col("o_totalprice") / 10000).alias("p"))
    joined = lines.join(orders, "k", "left")
    return _survey(joined.select(
        "k", F.coalesce(F.col("c"), F.lit(0)).alias("a"), F.coalesce("p", F.lit(0)).alias("b"),
        F.when(F.col("n") % 3 == 0, F.col("top")).otherwise(0).cast("bigint").alias("shift"),
    ))


def _survey(rows: DataFrame) -> DataFrame:
    """Answers from small whole numbers; ``shift`` makes a side differ."""
    a, b, k, s = F.col("a") + F.col("shift"), F.col("b") + F.col("shift"), F.col("k"), F.col("shift")

    def pick(number: Column, *answers: str) -> Column:
        return F.element_at(F.array(*(F.lit(x) for x in answers)), (number % len(answers) + 1).cast("int"))

    items = {f"item{n}": pick(F.floor(a / n), "1", "0", "", "checked") for n in range(1, 11)}
    names = ("sep1_v3___1", "sep1_v3___2", "sep1_v3___3", "sep1_v3___4", "sep4_v3", "sep_surg_v3___1",
             "sep_surg_v3___2", "sep_surg_v3___3", "sep_surg_v3___4", "sep_surg_v3___9")
    return rows.select(
        F.lit("7").alias("institution_v3"), F.col("k").cast("string").alias("record_id"),
        F.col("k").cast("string").alias("vid"),
        pick(F.floor(a / 7) + k, "1", "2", "3", "yes", "Not sure", "").alias("sepsis_ync_v3"),
        pick(F.floor(a / 5), "1", "2", "").alias("sepsis_uncertain_v3"),
        *(items[f"item{n}"].alias(name) for n, name in enumerate(names, 1)),
        pick(b, "Blood, Escherichia coli, (+)", "NO", "", "Urine, Klebsiella; Blood, Escherichia coli, (+)", "none").alias("sep3_v3"),
        F.when(b % 9 == 0, "").otherwise(F.format_string("%d.%d mmol/L", F.floor(b / 10), b % 10)).alias("sep6_v3"),
        F.format_string("%d, %d; %d", b % 7, (b + s) % 11, b % 5).alias("sep7_v3"),
        pick(b + s, "0", "1", "2", "").alias("sep_day_v3"),
        F.format_string("%02d:%02d", b % 25, a % 60).alias("sep_dt_v3"),
        pick(a + s, "0", "1", "3", "").alias("sep_days"),
        F.when(k % 6 == 0, "").otherwise((k % 6).cast("string")).alias("conf1"),
    )


def _survey_sql(source: str) -> str:
    def pick(number: str, *answers: str) -> str:
        listed = ", ".join(f"'{x}'" for x in answers)
        return f"[{listed}][CAST(({number}) % {len(answers)} + 1 AS BIGINT)]"

    names = ("sep1_v3___1", "sep1_v3___2", "sep1_v3___3", "sep1_v3___4", "sep4_v3", "sep_surg_v3___1",
             "sep_surg_v3___2", "sep_surg_v3___3", "sep_surg_v3___4", "sep_surg_v3___9")
    items = ", ".join(f"{pick(f'a // {n}', '1', '0', '', 'checked')} AS {name}" for n, name in enumerate(names, 1))
    return f"""SELECT '7' AS institution_v3, CAST(k AS VARCHAR) AS record_id, CAST(k AS VARCHAR) AS vid,
      {pick("a // 7 + k", "1", "2", "3", "yes", "Not sure", "")} AS sepsis_ync_v3,
      {pick("a // 5", "1", "2", "")} AS sepsis_uncertain_v3, {items},
      {pick("b", "Blood, Escherichia coli, (+)", "NO", "", "Urine, Klebsiella; Blood, Escherichia coli, (+)", "none")} AS sep3_v3,
      CASE WHEN b % 9 = 0 THEN '' ELSE printf('%d.%d mmol/L', b // 10, b % 10) END AS sep6_v3,
      printf('%d, %d; %d', b % 7, (b + s) % 11, b % 5) AS sep7_v3,
      {pick("b + s", "0", "1", "2", "")} AS sep_day_v3,
      printf('%02d:%02d', b % 25, a % 60) AS sep_dt_v3,
      {pick("a + s", "0", "1", "3", "")} AS sep_days,
      CASE WHEN k % 6 = 0 THEN '' ELSE CAST(k % 6 AS VARCHAR) END AS conf1
      FROM (SELECT k, a + s AS a, b + s AS b, s FROM ({source}))"""


HUMAN_SQL = _survey_sql("""SELECT o_orderkey AS k, o_custkey AS a, CAST(floor(o_totalprice / 10000) AS BIGINT) AS b,
  CAST(0 AS BIGINT) AS s FROM orders""")
MODEL_SQL = _survey_sql("""SELECT k, coalesce(o_custkey, 0) AS a,
  coalesce(CAST(floor(o_totalprice / 10000) AS BIGINT), 0) AS b,
  CASE WHEN n % 3 = 0 THEN top ELSE 0 END AS s
  FROM (SELECT l_orderkey AS k, count(*) AS n, CAST(max(l_linenumber) AS BIGINT) AS top FROM lineitem GROUP BY 1)
  LEFT JOIN orders ON o_orderkey = k""")
