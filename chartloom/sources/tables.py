"""Reading tables: CSV, Parquet, JSON lines, instrument dictionaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom import fixed_values as fixed
from chartloom.functions.text import plain_text, strip
from chartloom.operators import quality
from chartloom.operators.charts import chart_tables
from chartloom.schemas import lower_names
from chartloom.skew import number_rows

ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
# Spark reads Latin-1 but not windows-1252; they differ in these characters.
_LATIN = "".join(chr(code) for code in range(0x80, 0xA0) if code not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
_WINDOWS = _LATIN.encode("latin-1").decode("cp1252")


def _spark_encoding(encoding: str) -> str:
    return "ISO-8859-1" if encoding == "windows-1252" else encoding


def decoded(line: Column, encoding: str) -> Column:
    """Bytes that the text source handed over undecoded, as text."""
    text = F.decode(line.cast("binary"), _spark_encoding(encoding))
    return F.translate(text, _LATIN, _WINDOWS) if encoding == "windows-1252" else text


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV or Parquet by suffix, with lower-case names; only ``columns`` if given.

    CSV columns come as text; the operators cast what they need.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = read_csv(spark, path)
    df = lower_names(df)
    return df.select(*(c.strip().lower() for c in columns)) if columns else df


def csv_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes every line.

    The text source hands lines over undecoded, so the check runs in parallel
    over the bytes. Five bytes have no meaning in windows-1252; a file with one
    of them is Latin-1.
    """
    bytes_hex = F.hex(F.col("value").cast("binary"))
    row = spark.read.text(path).agg(
        F.max(~F.is_valid_utf8("value")).alias("not_utf8"),
        F.max(bytes_hex.rlike("^(..)*(81|8D|8F|90|9D)")).alias("undefined"),
    ).first()
    if not row["not_utf8"]:
        return ENCODINGS[0]
    return ENCODINGS[2] if row["undefined"] else ENCODINGS[1]


def csv_header(spark: SparkSession, path: str, encoding: str = ENCODINGS[0]) -> list[str]:
    """Column titles; missing or repeated ones are refused."""
    first = spark.read.option("encoding", _spark_encoding(encoding)).csv(path).limit(1).collect()
    names = [("" if v is None else v.lstrip("\ufeff")) for v in first[0]] if first else []
    if not names or all(n == "" for n in names):
        raise ValueError(f"CSV has no headers: {path}")
    if len(names) != len(set(names)):
        raise ValueError(f"CSV has duplicate headers: {path}")
    return names


def read_csv(
    spark: SparkSession, path: str, strict_width: bool = False, encoding: str | None = None, line_breaks: bool = True
) -> DataFrame:
    """CSV text columns, quotes and line breaks in cells included.

    Rows come in file order, so a file whose cells may hold line breaks is read by
    one task. Turn ``line_breaks`` off for files that have none, so that Spark
    splits them; ``split_csv.read_split_csv`` splits files with line breaks.

    With ``strict_width`` a row whose width differs from the header is an error
    when the table is read.
    """
    encoding = encoding or csv_encoding(spark, path)
    names = csv_header(spark, path, encoding)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = (
        spark.read.schema(schema)
        .option("header", True).option("enforceSchema", True).option("encoding", _spark_encoding(encoding))
        .option("multiLine", line_breaks).option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST" if strict_width else "PERMISSIVE")
        .csv(path)
    )
    if encoding == "windows-1252":
        rows = rows.select(*(F.translate(F.col(f"`{n}`"), _LATIN, _WINDOWS).alias(n) for n in names))
    return rows


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and one row with the number of skipped lines.

    Blank lines are ignored; broken lines and lines that are no object are
    skipped. A file that does not exist gives no rows.
    """
    lines = spark.read.text(path).filter(strip(F.col("value")) != "")
    is_object = F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull()
    rows = lines.filter(is_object).select(F.from_json("value", schema).alias("row")).select("row.*")
    skipped = lines.agg(F.count_if(~is_object).alias("skipped"))
    return rows, skipped


def read_predictions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Predictions as JSON lines or CSV, by suffix."""
    if path.endswith((".jsonl", ".json")):
        return read_json_lines(spark, path, schema)[0]
    return read_table(spark, path)


def load_chart_sources(spark: SparkSession, notes_path: str, visits_path: str | None = None):
    """Notes and visits in either dialect."""
    visits = read_table(spark, visits_path) if visits_path else None
    return chart_tables(read_table(spark, notes_path), visits)


def load_span_bundle(spark: SparkSession, folder: str, normalize_undetected: bool = True, labels: bool = True):
    """notes.csv and optional labels.csv of a folder, validated."""
    notes = read_csv(spark, f"{folder}/notes.csv").transform(lower_names)
    quality.require_clean(quality.note_violations(notes))
    if not labels:
        return notes, None
    clean = quality.clean_labels(read_csv(spark, f"{folder}/labels.csv"), normalize_undetected)
    quality.require_clean(quality.label_violations(clean, notes))
    return notes, clean


def with_source_rows(df: DataFrame, name: str = "source_row", first: int = 2) -> DataFrame:
    """Number file rows; the first data row of a CSV is 2.

    Spark's row ids grow within and across the parts of a file; they are made
    consecutive by counting rows per part.
    """
    ids = df.withColumn("_id", F.monotonically_increasing_id())
    return number_rows(ids, [F.col("_id")], F.shiftright("_id", 33), name, first=first).drop("_id")


# ------------------------------------------------------------------ instrument dictionary
def parse_choices(raw: Column, clean: bool = True) -> Column:
    """``code, label | code, label`` as an array of (code, label); later codes win."""
    chunks = F.filter(F.split(F.coalesce(raw, F.lit("")), r"\|"), lambda c: F.contains(c, F.lit(",")))

    def pair(chunk: Column) -> Column:
        label = F.substring(chunk, F.position(F.lit(","), chunk) + 1, F.length(chunk))
        return F.struct(
            strip(F.split(chunk, ",", 2)[0]).alias("code"),
            (plain_text(label) if clean else strip(label)).alias("label"),
        )

    return F.filter(F.transform(chunks, pair), lambda p: p["code"] != "")


def choice_map(pairs: Column) -> Column:
    """The pairs as a map; of a repeated code the last label counts."""
    last = F.filter(
        F.transform(pairs, lambda p, i: F.struct(
            p["code"].alias("code"), p["label"].alias("label"),
            F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["code"] == p["code"]).alias("again"))),
        lambda p: ~p["again"],
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["code"], p["label"])))


def instrument(rows: DataFrame, order: str = "field_order") -> DataFrame:
    """Dictionary rows as field specifications.

    ``rows`` has the dictionary's own titles and a column with the row order.
    """
    quality.require_columns(rows, (fixed.DICT_NAME, fixed.DICT_TYPE), "dictionary")

    def column(title: str) -> Column:
        return F.coalesce(F.col(f"`{title}`"), F.lit("")) if title in rows.columns else F.lit("")

    pairs = parse_choices(column(fixed.DICT_CHOICES))
    return rows.select(
        strip(column(fixed.DICT_NAME)).alias("field"),
        F.col(order).cast("bigint").alias("field_order"),
        strip(column(fixed.DICT_TYPE)).alias("field_type"),
        plain_text(column(fixed.DICT_LABEL)).alias("label"),
        pairs.alias("choice_list"),
        choice_map(pairs).alias("choices"),
        strip(column(fixed.DICT_BRANCH)).alias("branching"),
    )


def instrument_violations(fields: DataFrame, required: Sequence[str] = fixed.REQUIRED_SEPSIS_FIELDS,
                          ordered: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Blank or repeated fields, missing required ones, boundaries out of order."""
    spark = fields.sparkSession
    wanted = spark.createDataFrame([(name,) for name in required], "field string")
    parts = [
        quality.found(fields, "field_blank", F.col("field") == "", F.col("field_order")),
        quality.duplicates(fields.filter("field <> ''"), "field_repeated", ["field"]),
        quality.found(wanted.join(fields, "field", "left_anti"), "field_missing", F.lit(True), F.col("field")),
    ]
    for before, after in ordered:
        places = fields.agg(
            F.min(F.when(F.col("field") == before, F.col("field_order"))).alias("b"),
            F.min(F.when(F.col("field") == after, F.col("field_order"))).alias("a"),
        )
        parts.append(quality.found(places, "field_boundary_order", F.col("b") >= F.col("a"), F.lit(f"{before}|{after}")))
    return quality.all_of(parts)


def load_instrument(spark: SparkSession, path: str, required: Sequence[str] = fixed.REQUIRED_SEPSIS_FIELDS) -> DataFrame:
    """Read and check a dictionary file."""
    fields = instrument(with_source_rows(read_csv(spark, path), "field_order"))
    quality.require_clean(instrument_violations(fields, required))
    return fields
