"""Writing results. Every sink writes from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom import fixed_values as fixed
from chartloom.functions.text import safe_cell


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    return df.select(*(
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
        for f in df.schema.fields
    ))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, keep_negative_numbers: bool = True) -> None:
    """CSV that a spreadsheet opens without running a cell as a formula."""
    names = list(columns or df.columns)
    cells = flat(df.select(*names))
    text = cells.select(*(safe_cell(F.col(n), keep_negative_numbers).alias(n) for n in names))
    text.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_plain_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str) -> None:
    """Add rows as JSON lines; the committer makes the append all or nothing."""
    df.write.mode("append").json(path)


def write_batch(results: DataFrame, observations: DataFrame, folder: str) -> dict[str, str]:
    """Results as CSV, Parquet and JSON lines, and their OMOP rows as CSV."""
    paths = {kind: f"{folder}/{kind}" for kind in ("csv", "parquet", "jsonl", "omop")}
    write_plain_csv(results, paths["csv"])
    results.write.mode("overwrite").parquet(paths["parquet"])
    results.write.mode("overwrite").json(paths["jsonl"])
    write_plain_csv(observations, paths["omop"])
    return paths


def write_span_bundle(notes: DataFrame, visits: DataFrame, folder: str, manifest: DataFrame,
                      labels: DataFrame | None = None) -> dict[str, str]:
    """OMOP notes and visits, labels and a manifest row with the counts."""
    paths = {name: f"{folder}/{name}" for name in ("omop_notes", "omop_visits", "manifest")}
    write_plain_csv(notes, paths["omop_notes"])
    write_plain_csv(visits, paths["omop_visits"])
    if labels is not None:
        paths["labels"] = f"{folder}/labels"
        write_plain_csv(labels, paths["labels"])
    manifest.write.mode("overwrite").json(paths["manifest"])
    return paths


ADJUDICATION_COLUMNS = (
    "person_id", "visit_occurrence_id", "record_id", "vid", "institution_v3", "phenotype_status", "condition_present",
    "confidence_score", "clinical_rationale", "inference_backend", "review_flags", "adjudication_timestamp",
)
EVIDENCE_COLUMNS = ("record_id", "vid", "field_name", "source_type", "source_ref", "evidence_quote", "grounded")


def abstraction_manifest(adjudications: DataFrame, fields: DataFrame, run_ts: str, strict_rise: bool = False) -> DataFrame:
    """One row: encounters, statuses, and size and digest of the dictionary.

    The digest covers the field lines in order; the dictionary is a small file.
    """
    counts = adjudications.groupBy("phenotype_status").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("encounters_processed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("phenotype_status", "n")))).alias("status_counts"),
    )
    line = F.concat_ws("\t", "field", "field_type", "label", F.to_json("choices"), "branching")
    book = fields.agg(
        F.count(F.lit(1)).alias("dictionary_fields"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_order", line.alias("line")))),
                                        lambda x: x["line"]), "\n"), 256).alias("dictionary_sha256"),
    )
    # Both sides are aggregates of exactly one row.
    return totals.withColumn("_one", F.lit(1)).join(book.withColumn("_one", F.lit(1)), "_one").drop("_one").withColumns(
        {"strict_rise": F.lit(strict_rise), "generated_at": F.lit(run_ts)}
    )


def write_abstraction(survey: DataFrame, adjudications: DataFrame, evidence: DataFrame, manifest: DataFrame,
                      folder: str) -> dict[str, str]:
    """Survey import, adjudications, evidence and manifest."""
    paths = {n: f"{folder}/{n}" for n in ("survey_import", "adjudications", "field_evidence", "run_manifest")}
    write_csv(survey, paths["survey_import"], fixed.SURVEY_COLUMNS)
    write_csv(adjudications, paths["adjudications"], ADJUDICATION_COLUMNS)
    write_csv(evidence, paths["field_evidence"], EVIDENCE_COLUMNS)
    manifest.write.mode("overwrite").json(paths["run_manifest"])
    return paths


def write_review(review: DataFrame, evidence: DataFrame, folder: str) -> dict[str, str]:
    """Review sheet and evidence sheet; no cell is left as a formula."""
    paths = {"review": f"{folder}/review", "evidence": f"{folder}/evidence"}
    write_csv(review, paths["review"], keep_negative_numbers=False)
    write_csv(evidence, paths["evidence"], keep_negative_numbers=False)
    return paths


def write_concordance(results: dict[str, DataFrame], report: str, folder: str) -> dict[str, str]:
    """Metric tables as JSON, the report as one text file, discrepancies as CSV."""
    paths = {name: f"{folder}/{name}" for name in results}
    for name, df in results.items():
        if name == "discrepancies":
            write_csv(df, paths[name])
        else:
            df.write.mode("overwrite").json(paths[name])
    spark = next(iter(results.values())).sparkSession
    paths["report"] = f"{folder}/report"
    spark.createDataFrame([(report,)], "value string").write.mode("overwrite").text(paths["report"])
    return paths


def save_criteria(spark, text: str, path: str) -> None:
    """Keep one custom criteria text."""
    spark.createDataFrame([(text or "",)], "criteria string").write.mode("overwrite").json(path)


def load_criteria(spark, path: str) -> str | None:
    """The saved criteria text, or None."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("criteria string").json(path).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return ((row and row.criteria) or "").strip() or None
