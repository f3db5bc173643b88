"""OMOP export, audit rows and the lists a reviewer works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions import values
from chartloom.operators.agreement import binary_agreement
from chartloom.schemas import AUDIT, conform
from chartloom.skew import number_rows

VISITS_PER_CHUNK = 100_000


def observations(adjudications: DataFrame, condition: str, run_ts: str,
                 first_id: int = fixed.FIRST_OBSERVATION_ID) -> DataFrame:
    """Adjudications as OMOP OBSERVATION rows, numbered in visit order.

    Numbers come from counts per range of visit ids, so no task sees all rows.
    """
    numbered = number_rows(
        adjudications, [F.col("visit_occurrence_id"), F.col("person_id")],
        F.floor(F.coalesce("visit_occurrence_id", F.lit(0)) / VISITS_PER_CHUNK), "observation_id", first=first_id,
    )
    status = F.coalesce("phenotype_status", F.lit(fixed.NEGATIVE))
    zero = F.lit(0).cast("bigint")
    return numbered.select(
        F.col("observation_id").cast("bigint").alias("observation_id"),
        F.coalesce("person_id", F.lit(0)).alias("person_id"),
        F.lit(fixed.CONDITION_CONCEPTS.get(condition, fixed.DEFAULT_CONDITION_CONCEPT)).cast("bigint")
        .alias("observation_concept_id"),
        F.lit(run_ts[:10]).alias("observation_date"),
        F.lit(run_ts).alias("observation_datetime"),
        F.lit(fixed.ALGORITHM_TYPE_CONCEPT).cast("bigint").alias("observation_type_concept_id"),
        F.coalesce("confidence_score", F.lit(0.0)).alias("value_as_number"),
        status.alias("value_as_string"),
        values.status_concept(status).cast("bigint").alias("value_as_concept_id"),
        zero.alias("qualifier_concept_id"),
        zero.alias("unit_concept_id"),
        F.lit(None).cast("bigint").alias("provider_id"),
        F.coalesce("visit_occurrence_id", F.lit(0)).alias("visit_occurrence_id"),
        F.lit(None).cast("bigint").alias("visit_detail_id"),
        F.lit(f"Model adjudication: {condition}").alias("observation_source_value"),
        zero.alias("observation_source_concept_id"),
        F.lit("confidence_probability").alias("unit_source_value"),
        F.substring(F.coalesce("clinical_rationale", F.lit("")), 1, 250).alias("qualifier_source_value"),
    )


def status_counts(adjudications: DataFrame) -> DataFrame:
    return adjudications.groupBy("phenotype_status").agg(F.count(F.lit(1)).alias("n"))


def cohort_figures(adjudications: DataFrame) -> DataFrame:
    """Positives, negatives, share and mean confidence, in one aggregate."""
    n, yes = F.count(F.lit(1)), F.count_if("condition_present")
    return adjudications.agg(
        n.alias("total"), yes.alias("positive"), (n - yes).alias("negative"),
        F.round(F.when(n > 0, 100.0 * yes / n).otherwise(0.0), 1).alias("positive_pct"),
        F.round(F.avg("confidence_score"), 3).alias("mean_confidence"),
    )


def review_queue(adjudications: DataFrame, signed: DataFrame, show: str = "Unreviewed") -> DataFrame:
    """Rows still to review, or the positive or negative ones."""
    if show == "Unreviewed":
        return adjudications.join(signed.select("visit_occurrence_id"), "visit_occurrence_id", "left_anti")
    if show in ("Positive", "Negative"):
        present = F.coalesce("condition_present", F.lit(False))
        return adjudications.filter(present if show == "Positive" else ~present)
    return adjudications


def search_results(adjudications: DataFrame, status: str | None = None, text: str = "") -> DataFrame:
    """By status, and by a text in the visit id or the rationale."""
    rows = adjudications.filter(F.col("phenotype_status") == status) if status else adjudications
    wanted = text.strip().lower()
    if not wanted:
        return rows
    where = F.concat_ws("\n", F.col("visit_occurrence_id").cast("string"), F.lower("clinical_rationale"))
    return rows.filter(F.contains(where, F.lit(wanted)))


def quick_sample(visits: DataFrame, n: int = 5) -> DataFrame:
    return visits.orderBy("visit_occurrence_id").limit(n)


# ------------------------------------------------------------------ audit log
def normalize_audit(entries: DataFrame, run_ts: str | None = None) -> DataFrame:
    """Audit rows with every field filled in or derived.

    An override says what the person decided; otherwise the status does.
    """
    rows = conform(entries, AUDIT)

    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    status = F.coalesce(text("llm_status"), text("adjudication_status"), F.lit(""))
    decision = F.coalesce("human_decision", F.lit(""))
    says = F.contains(status, F.lit("POSITIVE"))
    human = F.when(F.contains(decision, F.lit("Override")), F.contains(decision, F.lit("Positive"))).otherwise(says)
    return rows.select(
        "visit_occurrence_id", "person_id",
        F.coalesce(text("reviewer_id"), F.lit("physician_01")).alias("reviewer_id"),
        F.coalesce(text("adjudication_status"), status).alias("adjudication_status"),
        status.alias("llm_status"), "llm_confidence",
        F.nullif(decision, F.lit("")).alias("human_decision"),
        F.coalesce("human_positive", human).alias("human_positive"),
        F.coalesce("llm_positive", says).alias("llm_positive"),
        F.coalesce("reviewer_agreement", F.lit(False)).alias("reviewer_agreement"),
        "override_reason", "comments",
        F.coalesce(text("timestamp"), F.lit(run_ts)).alias("timestamp"),
    )


def audit_agreement(entries: DataFrame) -> DataFrame:
    return binary_agreement(normalize_audit(entries))


def recent_audit(entries: DataFrame, n: int = 12) -> DataFrame:
    """The latest entries; ties by visit."""
    return entries.orderBy(F.desc_nulls_last("timestamp"), F.desc("visit_occurrence_id")).limit(n)
