"""Data-quality checks.

Every check returns ``rule, key, detail`` rows, one per violation, so checks run
as one distributed job. ``require_clean`` turns violations into an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions import values
from chartloom.functions.text import is_blank, strip
from chartloom.schemas import lower_names


def require_columns(df: DataFrame, names: Iterable[str], table: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns {', '.join(missing)}")


def found(df: DataFrame, rule: str, condition: Column, key: Column, detail: Column | None = None) -> DataFrame:
    """Rows of ``df`` that break a rule."""
    detail = F.lit(None) if detail is None else detail
    return df.filter(F.coalesce(condition, F.lit(False))).select(
        F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail")
    )


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require_clean(violations: DataFrame, shown: int = 5) -> None:
    """Raise when there is any violation; only a few are fetched to name them."""
    rows = violations.limit(shown).collect()
    if rows:
        raise ValueError("; ".join(f"{r.rule}: {r.key}" + (f" ({r.detail})" if r.detail else "") for r in rows))


def duplicates(df: DataFrame, rule: str, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once. Counts combine before the shuffle."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.select(
        F.lit(rule).alias("rule"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("key"),
        F.concat(F.lit("rows: "), F.col("n").cast("string")).alias("detail"),
    )


def _not_whole(name: str) -> Column:
    text = strip(F.col(name).cast("string"))
    return text.try_cast("double").isNull() | (text.try_cast("double") != F.floor(text.try_cast("double")))


def note_violations(notes: DataFrame) -> DataFrame:
    """Span-dialect notes: whole-number ids, unique row_id, some text."""
    notes = lower_names(notes)
    require_columns(notes, fixed.SPAN_NOTE_COLUMNS, "notes")
    parts = [
        found(notes, f"note_{name}_not_integer", _not_whole(name), F.col("row_id"), F.col(name))
        for name in ("row_id", "hadm_id", "subject_id")
    ]
    parts.append(duplicates(notes, "note_row_id_repeated", ["row_id"]))
    parts.append(found(notes, "note_text_blank", is_blank(F.col("text")), F.col("row_id")))
    return all_of(parts)


def clean_labels(labels: DataFrame, normalize_undetected: bool = False) -> DataFrame:
    """Trimmed, lower-cased labels; optionally dashes where nothing was detected."""
    labels = lower_names(labels)
    require_columns(labels, fixed.SPAN_LABEL_COLUMNS, "labels")

    def text(name: str) -> Column:
        return strip(F.coalesce(F.col(name).cast("string"), F.lit("")))

    def low(name: str) -> Column:
        return F.lower(text(name))

    undetected = (low("detection") == "no") & F.lit(normalize_undetected)
    return labels.select(
        *(F.col(n).cast("string").try_cast("double").cast("bigint").alias(n) if dict(labels.dtypes)[n] == "string"
          else F.col(n).cast("bigint").alias(n) for n in ("row_id", "start", "end")),
        text("trigger_word").alias("trigger_word"),
        text("concept").alias("concept"),
        F.nullif(low("semtypes"), F.lit("")).alias("semtypes"),
        low("detection").alias("detection"),
        F.when(undetected, "-").otherwise(low("encounter")).alias("encounter"),
        F.when(undetected, "-").otherwise(low("negation")).alias("negation"),
    ).select(*fixed.SPAN_LABEL_COLUMNS)


def label_domain_violations(labels: DataFrame) -> DataFrame:
    """Values outside their domain, and undetected labels that say more than a dash."""
    key = F.concat_ws("|", F.col("row_id").cast("string"), "concept", F.col("start").cast("string"))
    domains = {
        "semtypes": fixed.SEMTYPES, "detection": fixed.DETECTION_VALUES,
        "encounter": fixed.ENCOUNTER_VALUES, "negation": fixed.NEGATION_VALUES,
    }
    rules = [
        F.when(~F.col(name).isin(*domain), F.struct(F.lit(f"label_{name}_domain").alias("rule"), F.col(name).alias("detail")))
        for name, domain in domains.items()
    ]
    says_more = (F.col("detection") == "no") & ((F.col("encounter") != "-") | (F.col("negation") != "-"))
    rules.append(F.when(says_more, F.struct(
        F.lit("label_undetected_not_dash").alias("rule"), F.concat_ws("/", "encounter", "negation").alias("detail"))))
    return labels.select(key.alias("key"), F.explode(F.array_compact(F.array(*rules))).alias("v")).select(
        "v.rule", "key", "v.detail"
    )


def label_note_violations(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Labels of unknown notes, and spans that do not hold their trigger."""
    notes = lower_names(notes).select(F.col("row_id").cast("bigint").alias("row_id"), F.col("text").alias("note"))
    orphans = labels.join(notes, "row_id", "left_anti")
    inside = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("note"))
    held = F.substring("note", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    joined = labels.join(notes, "row_id")
    key = F.concat_ws("|", F.col("row_id").cast("string"), "concept", F.col("start").cast("string"))
    rule = F.when(~inside, "label_span_outside").when(held != F.col("trigger_word"), "label_span_text")
    bad = joined.withColumn("rule", rule).filter(F.col("rule").isNotNull())
    return found(orphans, "label_note_unknown", F.lit(True), F.col("row_id")).unionByName(
        bad.select("rule", key.alias("key"), F.when(inside, held).alias("detail"))
    )


def label_violations(labels: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    parts = [label_domain_violations(labels)]
    if notes is not None:
        parts.append(label_note_violations(labels, notes))
    return all_of(parts)


def missing_predictions(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold (row_id, concept) keys nobody predicted."""
    keys = ["row_id", "concept"]
    return found(
        gold.select(*keys).join(predictions.select(*keys), keys, "left_anti"), "prediction_missing", F.lit(True),
        F.concat_ws("|", F.col("row_id").cast("string"), "concept"),
    )


def survey_key_violations(rows: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Survey rows without ``vid`` and repeated join keys."""
    text = rows.select(*(strip(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in keys))
    return found(text, f"{side}_vid_missing", F.col("vid") == "", F.concat_ws("|", *keys)).unionByName(
        duplicates(text, f"{side}_key_repeated", keys)
    )


def linkage_violations(rows: DataFrame, key: str = "source_row") -> DataFrame:
    """Rows without institution, record or visit id."""
    return all_of([
        found(rows, f"{name}_missing", is_blank(F.col(name)), F.col(key)) for name in ("institution_v3", "record_id", "vid")
    ])


def unread_times(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose time is written in a shape that ``lenient_timestamp`` cannot read, with rule and text."""
    text = F.trim(F.col(column).cast("string"))
    unread = (F.coalesce(text, F.lit("")) != "") & values.lenient_timestamp(F.col(column)).isNull()
    return rows.filter(unread).withColumn("rule", F.lit("unread_time")).withColumn("detail", text)
