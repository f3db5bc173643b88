"""Table shapes and ``conform``, which brings a table into one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {
    "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "int": T.IntegerType(),
    "strings": T.ArrayType(T.StringType()),
}


def _table(columns: str) -> T.StructType:
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


_KINDS["evidence"] = T.ArrayType(
    _table("note_id bigint, note_date string, evidence_quote string, interpretation string")
)

NOTE = _table(
    "note_id bigint, person_id bigint, visit_occurrence_id bigint, note_date date, "
    "note_datetime timestamp_ntz, note_type_concept_id bigint, note_title string, note_text string"
)
VISIT = _table(
    "visit_occurrence_id bigint, person_id bigint, visit_concept_id bigint, visit_start_date string, "
    "visit_end_date string, visit_type_concept_id bigint, care_site_id bigint"
)
ENCOUNTER = _table(
    "visit_occurrence_id string, person_id string, record_id string, institution_v3 string, "
    "icu_admit_datetime string, visit_start_datetime string, visit_start_date string"
)
MEASUREMENT = _table(
    "visit_occurrence_id string, measurement_id string, measurement_datetime string, "
    "measurement_name string, value_as_number string, value_as_string string, unit string"
)
DRUG = _table(
    "visit_occurrence_id string, drug_exposure_id string, drug_start_datetime string, "
    "drug_end_datetime string, drug_name string, route string, dose_rate string, drug_class string"
)
CULTURE = _table(
    "visit_occurrence_id string, culture_id string, collection_datetime string, source string, "
    "organism string, result string"
)
PANEL_NOTE = _table(
    "note_id string, visit_occurrence_id string, note_date string, note_datetime string, "
    "note_type_concept_id string, note_title string, note_text string"
)
SPAN_NOTE = _table("row_id bigint, hadm_id bigint, subject_id bigint, text string")
SPAN_LABEL = _table(
    "row_id bigint, trigger_word string, concept string, semtypes string, start bigint, end bigint, "
    "detection string, encounter string, negation string"
)
EVIDENCE = "array<struct<note_id:bigint,note_date:string,evidence_quote:string,interpretation:string>>"
CHART = _table(
    "person_id bigint, visit_occurrence_id bigint, visit_start_date string, visit_end_date string, "
    "note_count bigint, notes_formatted_text string"
)
ADJUDICATION = _table(
    "person_id bigint, visit_occurrence_id bigint, condition_present boolean, phenotype_status string, "
    "confidence_score double, primary_criteria_met strings, "
    "key_evidence evidence, clinical_rationale string, adjudication_timestamp string, "
    "inference_backend string"
)
FIELD_EVIDENCE = _table(
    "record_id string, vid string, field_name string, source_type string, source_ref string, "
    "evidence_quote string, grounded boolean"
)
AUDIT = _table(
    "visit_occurrence_id bigint, person_id bigint, reviewer_id string, adjudication_status string, "
    "llm_status string, llm_confidence double, human_decision string, human_positive boolean, "
    "llm_positive boolean, reviewer_agreement boolean, override_reason string, comments string, "
    "timestamp string"
)


def lower_names(df: DataFrame) -> DataFrame:
    """Trim and lower-case the column names."""
    return df.toDF(*(name.strip().lower() for name in df.columns))


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Select the columns of ``schema``: missing ones become null, bad values too.

    Whole numbers written with a decimal point ("20001.0") are accepted as ids.
    """
    df = lower_names(df)
    have = dict(df.dtypes)
    columns = []
    for field in schema.fields:
        kind = field.dataType.simpleString()
        if field.name not in have:
            value = F.lit(None).cast(field.dataType)
        elif have[field.name] == kind:
            value = F.col(field.name)
        elif kind == "bigint":
            value = whole_number(F.col(field.name))
        elif kind == "string" and have[field.name] in ("double", "float"):
            number = F.col(field.name)
            value = F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
                number.cast("string")
            )
        else:
            value = F.col(field.name).try_cast(field.dataType)
        columns.append(value.alias(field.name))
    if keep_extra:
        columns += [F.col(name) for name in df.columns if name not in schema.fieldNames()]
    return df.select(*columns)


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Lower-case names and missing columns as nulls; types stay as they are."""
    df = lower_names(df)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def number_column(df: DataFrame, name: str):
    """A number, null when absent, not a number or NaN."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("double")
    value = F.col(name).try_cast("double") if kind != "string" else F.trim(F.col(name)).try_cast("double")
    return F.when(~F.isnan(value), value)


def id_column(df: DataFrame, name: str):
    """An id column as bigint, null when absent or not a number."""
    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("bigint")
    return F.col(name).cast("bigint") if kind in ("bigint", "int") else whole_number(F.col(name))


def time_column(df: DataFrame, name: str):
    """A time column as timestamp without zone, null when absent or not a time."""
    from chartloom.functions.values import lenient_timestamp

    kind = dict(df.dtypes).get(name)
    if kind is None:
        return F.lit(None).cast("timestamp_ntz")
    if kind in ("timestamp_ntz", "date", "timestamp"):
        return F.col(name).cast("timestamp_ntz")
    return lenient_timestamp(F.col(name))


def whole_number(value):
    """An id as bigint; null when it is not a number."""
    text = F.trim(value.cast("string"))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
