"""Visit index, charts, note panels and staged views."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions import values
from chartloom.functions.text import is_blank, once, plain_number, scrub_dates, strip
from chartloom.schemas import PANEL_NOTE, SPAN_NOTE, conform, id_column, lower_names, time_column, whole_number, with_missing
from chartloom.session import reliable_checkpoint
from chartloom.skew import Crowd, crowded_keys, first_n, join_spread, join_together, number_rows

FAR_FUTURE = "9999-12-31 00:00:00"


def is_span_dialect(columns: Iterable[str]) -> bool:
    """Notes given as (row_id, hadm_id, subject_id, text)."""
    names = {name.strip().lower() for name in columns}
    return set(fixed.SPAN_NOTE_COLUMNS) <= names and "note_text" not in names


def span_notes_to_omop(notes: DataFrame) -> DataFrame:
    """Span-dialect notes as NOTE rows."""
    return conform(notes, SPAN_NOTE).select(
        F.col("row_id").alias("note_id"),
        F.col("subject_id").alias("person_id"),
        F.col("hadm_id").alias("visit_occurrence_id"),
        F.lit(None).cast("date").alias("note_date"),
        F.lit(None).cast("timestamp_ntz").alias("note_datetime"),
        F.lit(fixed.NURSING_NOTE_TYPE_CONCEPT).cast("bigint").alias("note_type_concept_id"),
        F.lit("Nursing Note").alias("note_title"),
        F.col("text").alias("note_text"),
    )


def visits_of_span_notes(notes: DataFrame) -> DataFrame:
    """One visit per hadm_id; its person is the one on the lowest row_id."""
    return (
        conform(notes, SPAN_NOTE)
        .groupBy(F.col("hadm_id").alias("visit_occurrence_id"))
        .agg(F.min_by("subject_id", "row_id").alias("person_id"))
        .select(
            "visit_occurrence_id",
            "person_id",
            F.lit(fixed.INPATIENT_VISIT_CONCEPT).cast("bigint").alias("visit_concept_id"),
            F.lit("").alias("visit_start_date"),
            F.lit("").alias("visit_end_date"),
            F.lit(fixed.VISIT_TYPE_CONCEPT).cast("bigint").alias("visit_type_concept_id"),
            F.lit(None).cast("bigint").alias("care_site_id"),
        )
    )


def chart_tables(notes: DataFrame, visits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Notes and visits in NOTE / VISIT_OCCURRENCE form, whichever dialect came in."""
    if is_span_dialect(notes.columns):
        return span_notes_to_omop(notes), visits_of_span_notes(notes)
    if visits is None:
        raise ValueError("a visit table is required unless the notes are in the span dialect")
    return lower_names(notes), lower_names(visits)


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def clean_visits(visits: DataFrame) -> DataFrame:
    """Rows with a usable visit id; a missing person becomes 0."""
    visits = lower_names(visits)
    unknown = F.lit("Unknown")
    return visits.select(
        id_column(visits, "visit_occurrence_id").alias("visit_occurrence_id"),
        F.coalesce(id_column(visits, "person_id"), F.lit(0)).alias("person_id"),
        _column(visits, "visit_start_date", unknown).cast("string").alias("visit_start_date"),
        _column(visits, "visit_end_date", unknown).cast("string").alias("visit_end_date"),
    ).filter(F.col("visit_occurrence_id").isNotNull())


def clean_notes(notes: DataFrame) -> DataFrame:
    """Notes with a usable visit id and some text.

    ``note_time`` orders the notes (null last); ``note_when`` is how the date is
    written in charts and evidence.
    """
    notes = lower_names(notes)
    moment = "note_datetime" if "note_datetime" in notes.columns else "note_date"
    title = _column(notes, "note_title", _column(notes, "note_type_concept_id", F.lit("Clinical Note")))
    return notes.select(
        id_column(notes, "visit_occurrence_id").alias("visit_occurrence_id"),
        id_column(notes, "note_id").alias("note_id"),
        time_column(notes, moment).alias("note_time"),
        title.cast("string").alias("note_title"),
        F.col("note_text").cast("string").alias("note_text"),
    ).filter(F.col("visit_occurrence_id").isNotNull() & ~is_blank(F.col("note_text"))).withColumn(
        "note_when", F.coalesce(F.date_format("note_time", "yyyy-MM-dd HH:mm:ss"), F.lit("NaT"))
    )


def only_visits(df: DataFrame, visit_ids: DataFrame | Iterable[int]) -> DataFrame:
    """Keep the listed visits: a short list, or a table of ids of any size."""
    if isinstance(visit_ids, DataFrame):
        wanted = visit_ids.select(whole_number(F.col("visit_occurrence_id")).alias("visit_occurrence_id"))
        return df.join(wanted, "visit_occurrence_id", "left_semi")
    return df.filter(F.col("visit_occurrence_id").isin(*(int(v) for v in visit_ids)))


def notes_per_visit(notes: DataFrame) -> DataFrame:
    notes = lower_names(notes)
    return (
        notes.select(id_column(notes, "visit_occurrence_id").alias("visit_occurrence_id"))
        .filter(F.col("visit_occurrence_id").isNotNull())
        .groupBy("visit_occurrence_id")
        .agg(F.count(F.lit(1)).alias("note_count"))
    )


def visit_index(notes: DataFrame, visits: DataFrame | None = None) -> DataFrame:
    """Visits with their number of notes. The note text is never read."""
    notes, visits = chart_tables(notes, visits)
    return (
        clean_visits(visits)
        .join(notes_per_visit(notes), "visit_occurrence_id", "left")
        .withColumn("note_count", F.coalesce("note_count", F.lit(0)))
    )


NOTE_ORDER = ("note_time", "note_id")


def first_notes(notes: DataFrame, max_notes: int, max_chars: int | None = None) -> DataFrame:
    """The first notes of each visit in time order, cut to ``max_chars`` where that is given."""
    if max_chars is not None:
        notes = notes.withColumn("note_text", F.substring("note_text", 1, max_chars))
    return first_n(
        notes, ["visit_occurrence_id"], [F.asc_nulls_last(c) for c in NOTE_ORDER], max_notes,
        spread=("note_id", "note_time"), rank="note_rank",
    )


def load_charts(
    notes: DataFrame,
    visits: DataFrame | None = None,
    target_visits: DataFrame | Iterable[int] | None = None,
    max_notes: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """One chart per visit: all its notes, whole, in time order as one text.

    A caller that asks for the first ``max_notes`` notes, or for notes cut to
    ``max_chars``, also gets the column ``notes_dropped``. A chart is one row, so
    it has to fit in a row; ``chart_blocks`` is the same text note by note for
    visits of any size.
    """
    notes, visits = chart_tables(notes, visits)
    notes, visits = clean_notes(notes), clean_visits(visits)
    if target_visits is not None:
        notes, visits = only_visits(notes, target_visits), only_visits(visits, target_visits)
    blocks = chart_blocks(notes, max_notes, max_chars)
    place = F.struct(*(F.col(c) for c in BLOCK_ORDER), F.col("block"))
    texts = (
        blocks.groupBy("visit_occurrence_id")
        .agg(F.count(F.lit(1)).alias("note_count"), F.array_sort(F.collect_list(place)).alias("blocks"))
        .select("visit_occurrence_id", "note_count", F.array_join(F.col("blocks.block"), "\n").alias("notes_formatted_text"))
    )
    rows = visits.join(texts, "visit_occurrence_id", "left")
    dropped = []
    if max_notes is not None:
        rows = rows.join(notes.groupBy("visit_occurrence_id").agg(F.count(F.lit(1)).alias("_all")), "visit_occurrence_id", "left")
        dropped = [(F.coalesce("_all", F.lit(0)) - F.coalesce("note_count", F.lit(0))).alias("notes_dropped")]
    return rows.select(
        "person_id", "visit_occurrence_id", "visit_start_date", "visit_end_date",
        F.coalesce("note_count", F.lit(0)).alias("note_count"),
        F.coalesce("notes_formatted_text", F.lit(fixed.NO_NOTES)).alias("notes_formatted_text"),
        *dropped,
    )


BLOCK_ORDER = ("undated", "note_time", "nameless", "note_id")


def chart_blocks(notes: DataFrame, max_notes: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The chart's text note by note: ``visit_occurrence_id``, the columns that order it, and ``block``."""
    if max_notes is not None:
        notes = first_notes(notes, max_notes)
    header = F.concat(
        F.lit("--- [Note ID: "), F.coalesce(F.col("note_id").cast("string"), F.lit("N/A")),
        F.lit(" | Date: "), F.col("note_when"),
        F.lit(" | Type/Title: "), F.coalesce("note_title", F.lit("None")), F.lit("] ---\n"),
    )
    text = F.col("note_text") if max_chars is None else F.substring("note_text", 1, max_chars)
    return notes.select(
        "visit_occurrence_id", F.col("note_time").isNull().alias("undated"), "note_time",
        F.col("note_id").isNull().alias("nameless"), "note_id", F.concat(header, strip(text), F.lit("\n")).alias("block"),
    )


def notes_with_keyword(notes: DataFrame, keyword: str) -> DataFrame:
    """Notes whose title, date or text holds the keyword, whatever the case."""
    where = F.concat_ws(" ", F.col("note_id").cast("string"), "note_when", "note_title", "note_text")
    return notes.filter(F.contains(F.lower(where), F.lit(keyword.strip().lower())))


# ------------------------------------------------------------------ panels and stages
def panel(title: Column) -> Column:
    """The chart panel a note title belongs to; the first pattern wins."""
    kind = F.lit(fixed.DEFAULT_PANEL)
    for name, pattern in reversed(fixed.PANEL_PATTERNS):
        kind = F.when(title.rlike("(?iu)" + pattern), name).otherwise(kind)
    return kind


def note_moment(notes: DataFrame) -> Column:
    """Time of a note, else its date."""
    return F.coalesce(time_column(notes, "note_datetime"), time_column(notes, "note_date"))


def day_number(moment: Column) -> Column:
    """Days since 1970; what has no time comes last."""
    return F.unix_date(F.to_date(F.coalesce(moment, F.lit(FAR_FUTURE).cast("timestamp_ntz")))).cast("bigint")


def crowded_visits(notes: DataFrame, measurements: DataFrame, cultures: DataFrame, drugs: DataFrame) -> Crowd:
    """Visits with more rows than one task should put in order. No text is read."""
    every = None
    for table in (notes, measurements, cultures, drugs):
        rows = lower_names(table).select("visit_occurrence_id").groupBy("visit_occurrence_id").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select(values.visit_key(F.col("visit_occurrence_id")).alias("vid"), "n")
        every = rows if every is None else every.unionByName(rows)
    return crowded_keys(every.filter(F.col("vid").isNotNull()), ["vid"], count=F.sum("n"))


def panel_notes(notes: DataFrame, anchors: DataFrame, max_chars: int | None = None, crowded: Crowd | None = None) -> DataFrame:
    """Notes with panel, scrubbed text and header, per visit key ``vid``.

    ``anchors`` has one row per visit: ``vid`` and the reference time ``t0_time``.
    A note without a numeric id takes its place among all notes of the visit as
    id, or the next number that no note of the visit has. Notes are whole unless
    the caller asks for a cut. Given the ``crowded`` visits, the notes of all
    others are left together for ``stage_views``.
    """
    notes = with_missing(notes, PANEL_NOTE)
    title = F.coalesce(
        F.when(F.col("note_title") != "", F.col("note_title")), F.col("note_type_concept_id").cast("string"), F.lit("Clinical Note")
    )
    rows = notes.select(
        values.visit_key(F.col("visit_occurrence_id")).alias("vid"),
        id_column(notes, "note_id").alias("note_id"),
        note_moment(notes).alias("note_time"),
        strip(title).alias("title"),
        strip(F.col("note_text")).alias("raw_text"),
    ).filter(F.col("vid").isNotNull() & ~is_blank(F.col("raw_text")))
    rows = _number_missing_ids(rows)
    cut = F.substring("raw_text", 1, max_chars) if max_chars is not None else F.col("raw_text")
    # The text of a visit is spread over tasks by note, or that of a crowded one by day.
    times = anchors.select("vid", "t0_time")
    if crowded is None:
        rows, dealt = join_spread(rows, times, ["vid"], F.col("note_id")), []
    else:
        rows, dealt = join_together(rows, times, day_number(F.col("note_time")), crowded), ["_piece"]
    rows = rows.select(
        "vid", *dealt, "note_id", "note_time", "title", panel(F.col("title")).alias("panel"),
        scrub_dates(cut).alias("note_text"),
        values.offset_label(F.col("note_time"), F.col("t0_time")).alias("note_when"),
    )
    header = F.concat(
        F.lit("--- [Note ID: "), F.col("note_id").cast("string"), F.lit(" | "), F.col("note_when"),
        F.lit(" | Panel: "), F.col("panel"), F.lit(" | Title: "), F.col("title"), F.lit("] ---\n"),
    )
    return rows.withColumn("block", F.concat(header, F.col("note_text")))


def _number_missing_ids(rows: DataFrame) -> DataFrame:
    """Notes without an id get their place in time order among all notes of the visit.

    Where another note of the visit owns that number, the place is moved behind
    the visit's largest id. Only ids and times are numbered, in visits that have
    such notes; texts are joined back for the notes without an id alone.
    """
    nameless = rows.filter(F.col("note_id").isNull())
    if nameless.select("vid").isEmpty():
        return rows
    mark = F.xxhash64("raw_text", "title")
    # All texts are read for their marks, so that is done once.
    narrow = reliable_checkpoint(
        rows.join(nameless.select("vid").distinct(), "vid", "left_semi").select("vid", "note_id", "note_time", mark.alias("mark")))
    # Undated notes come last, in the order of a hash of their text.
    undated = F.lit(10_000_000) + F.pmod(F.col("mark"), F.lit(1000))
    chunk = F.coalesce(F.unix_date(F.to_date("note_time")).cast("bigint"), undated)
    placed = number_rows(narrow, [F.col("note_time"), F.col("note_id").asc_nulls_last(), F.col("mark")], chunk, "place", keys=["vid"])
    named = placed.filter(F.col("note_id").isNotNull())
    largest = named.groupBy("vid").agg(F.max("note_id").alias("largest"))
    taken = named.select("vid", F.col("note_id").alias("place")).distinct().withColumn("taken", F.lit(True))
    numbers = (
        placed.filter(F.col("note_id").isNull()).join(taken, ["vid", "place"], "left").join(largest, "vid", "left")
        .withColumn("number", F.when(F.col("taken"), F.col("largest") + F.col("place")).otherwise(F.col("place")))
        .groupBy("vid", "note_time", "mark").agg(F.min("number").alias("number"))
        .select(F.col("vid").alias("_vid"), F.col("note_time").alias("_time"), F.col("mark").alias("_mark"), "number")
    )
    nameless = nameless.withColumn("mark", mark)
    same = (nameless["vid"] == numbers["_vid"]) & nameless["note_time"].eqNullSafe(numbers["_time"]) & (nameless["mark"] == numbers["_mark"])
    filled = nameless.join(numbers, same).withColumn("note_id", F.col("number")).select(*rows.columns)
    return rows.filter(F.col("note_id").isNotNull()).unionByName(filled)


def structured_lines(
    measurements: DataFrame, cultures: DataFrame, drugs: DataFrame, anchors: DataFrame,
    holding: Callable[[Column], Column] | None = None, crowded: Crowd | None = None,
) -> DataFrame:
    """One text line per measurement, culture and medication, with its offset.

    ``holding`` keeps the lines that pass a test. It is put to the lower-case line
    before the reference times are known, so the offsets are left out of it. Given
    the ``crowded`` visits, the lines of all others are left together for ``stage_views``.
    """
    # Offsets are counted in days, so the day of a reference time is looked up once for all lines.
    anchor = anchors.select("vid", F.to_date("t0_time").alias("t0_day"))
    dealt = [] if crowded is None else ["_piece"]

    def at(moment: str) -> Column:
        return values.offset_label(F.col(moment), F.col("t0_day"))

    def untimed(moment: str) -> Column:
        return F.lit("")

    def lines(df: DataFrame, section: str, place: int, moment: str, text: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
        if holding is not None:
            df = once(df, "_low", F.lower(text(untimed))).filter(holding(F.col("_low"))).drop("_low")
        timed = (
            join_spread(df, anchor, ["vid"], F.col(moment)) if crowded is None
            else join_together(df, anchor, day_number(F.col(moment)), crowded)
        )
        return (
            timed.select("vid", *dealt, F.lit(place).alias("section_order"), F.lit(section).alias("section"),
                    F.col(moment).alias("line_time"), text(at).alias("line"))
        )

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    number = F.coalesce(plain_number(F.col("value")), F.trim(shown("value_as_string")))

    def vitals(at: Callable[[str], Column]) -> Column:
        return F.trim(F.concat(F.lit("- ["), at("moment"), F.lit("] "), shown("measurement_name"), F.lit(": "), number,
                               F.lit(" "), F.trim(shown("unit"))))

    def micro(at: Callable[[str], Column]) -> Column:
        return F.concat(F.lit("- ["), at("moment"), F.lit("] "), shown("source"), F.lit(" | "), shown("organism"),
                        F.lit(" | "), shown("result"))

    def given(at: Callable[[str], Column]) -> Column:
        return F.concat(
            F.lit("- ["), at("start_time"), F.lit(" -> "), at("end_time"), F.lit("] "), shown("drug_name"),
            F.when(shown("dose_rate") != "", F.concat(F.lit(" ("), F.col("dose_rate"), F.lit(")"))).otherwise(""),
            F.when(shown("route") != "", F.concat(F.lit(" ["), F.col("route"), F.lit("]"))).otherwise(""),
        )

    return (
        lines(measurements, "[Structured Vital Signs & Labs]", 1, "moment", vitals)
        .unionByName(lines(cultures, "[Structured Microbiology]", 2, "moment", micro))
        .unionByName(lines(drugs, "[Structured Medications]", 3, "start_time", given))
    )


STAGES = ("stage1", "stage2", "stage3")
# Stages that read a piece, as one number: 1, 2 and 4 added up.
READ_BY = {number: [s for k, s in enumerate(STAGES) if number >> k & 1] for number in range(8)}


def stage_pieces(notes: DataFrame, lines: DataFrame, per_stage: bool = True) -> DataFrame:
    """Every piece of text of every stage view, in long form.

    Stage 1 reads discharge summaries, stage 2 H&P notes and structured lines,
    stage 3 everything. A view is the pieces of one (vid, stage) in the order of
    ``section_order, piece_time, piece_id``. Nothing is cut and no visit is
    gathered in one place. With ``per_stage`` off a piece is one row, and ``reads``
    tells its stages (``READ_BY``); the pieces of a section have the same ones.
    """
    dealt = ["_piece"] if "_piece" in notes.columns and "_piece" in lines.columns else []
    note_rows = notes.select(
        "vid", *dealt, "panel", F.lit(0).alias("section_order"), F.lit("").alias("section"),
        F.coalesce("note_time", F.lit(FAR_FUTURE).cast("timestamp_ntz")).alias("piece_time"),
        F.col("note_id").alias("piece_id"), F.col("block").alias("piece"),
    )
    line_rows = lines.select(
        "vid", *dealt, F.lit(None).cast("string").alias("panel"), "section_order", "section",
        F.coalesce("line_time", F.lit(FAR_FUTURE).cast("timestamp_ntz")).alias("piece_time"),
        F.lit(None).cast("bigint").alias("piece_id"), F.col("line").alias("piece"),
    )
    rows = note_rows.unionByName(line_rows)
    is_line = F.col("panel").isNull()
    reads = F.when(F.col("panel") == "discharge_summary", 0b101).when(is_line | (F.col("panel") == "hp"), 0b110).otherwise(0b100)
    rows = rows.withColumn("reads", reads).drop("panel")
    if not per_stage:
        return rows
    # Whole arrays to choose from: a list put together for each row costs more than the rest of the row.
    stages = F.array(*(F.array(*(F.lit(s) for s in names)).cast("array<string>") for names in READ_BY.values()))
    return rows.withColumn("stage", F.explode(F.get(stages, F.col("reads")))).drop("reads", "_piece")


# Rows of a view in the making: what a group begins with, its pieces, its end.
BEGIN, PIECE, END = 0, 1, 2
# What a row shows, as tens; the ones are the place of the stage in ``STAGES``.
AS_PIECE, AS_TITLE, AS_MISSING = 0, 10, 20


def stage_views(pieces: DataFrame, visits: DataFrame, crowded: Crowd | None = None) -> DataFrame:
    """Stage views as a long table: ``vid, stage, part, view``.

    A row is one piece of the view, a note, a line or the title of a section;
    ``part`` counts from 1 within the view. A view without pieces has one row that
    says so. The shape is the same at every size.

    A visit is put in order once for all its views, by one task. ``crowded`` visits,
    looked for in the pieces when not given, are put in order by section and day,
    so no task numbers a whole one. Pieces come one row per stage, or one row
    with ``reads``.
    """
    lanes = ["stage"] if "stage" in pieces.columns else []
    bits = [1 << k for k in range(len(STAGES))]
    if crowded is None:
        crowded = crowded_keys(pieces.select("vid"), ["vid"])
    if lanes:
        reads = F.lit(0)
        for stage, bit in zip(STAGES, bits):
            reads = F.when(F.col("stage") == stage, bit).otherwise(reads)
        pieces = pieces.withColumn("reads", reads)
    if "_piece" not in pieces.columns:
        pieces = pieces.withColumn("_piece", F.lit(0))
    group = ["vid", *lanes, "_piece", "_chunk"]
    chunk = F.when(F.col("_crowded"), F.col("section_order") * 20_000_000 + day_number(F.col("piece_time"))).otherwise(0)
    rows = crowded.marked(pieces).select(
        "vid", *lanes, "_piece", chunk.cast("bigint").alias("_chunk"), F.lit(PIECE).alias("mark"), "section_order", "section",
        "piece_time", F.coalesce("piece_id", F.lit(0)).alias("piece_id"), F.col("piece").alias("view"), "reads",
        F.lit(None).cast("array<bigint>").alias("at"), F.lit(None).cast("int").alias("copies"), "_crowded")

    def mark(df: DataFrame, kind: Column, last_section: Column, at: Column) -> DataFrame:
        """Rows around the pieces of a group: its first numbers, the section it goes on with, the copies of its visit."""
        answers = F.coalesce(*(F.when(F.col(c) == s, b) for c in lanes for s, b in zip(STAGES, bits)), F.lit(sum(bits)))
        return df.select(
            *group, kind.cast("int").alias("mark"), last_section.cast("int").alias("section_order"), F.lit("").alias("section"),
            F.lit(None).cast("timestamp_ntz").alias("piece_time"), F.lit(None).cast("bigint").alias("piece_id"),
            F.lit(None).cast("string").alias("view"), answers.alias("reads"), at.cast("array<bigint>").alias("at"), "copies")

    def per_lane(df: DataFrame) -> DataFrame:
        return df.withColumn("stage", F.explode(F.array(*(F.lit(s) for s in STAGES)))) if lanes else df

    visits = visits.groupBy("vid").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    zeros = F.array(*(F.lit(0) for _ in STAGES))
    alone = per_lane(crowded.without(visits)).withColumns({"_piece": F.lit(0), "_chunk": F.lit(0).cast("bigint")})
    alone = alone.withColumn("kind", F.explode(F.array(F.lit(BEGIN), F.lit(END))))
    marks = mark(alone, F.col("kind"), F.lit(None), F.when(F.col("kind") == BEGIN, zeros))
    if crowded.found is not None:
        marks = marks.unionByName(_marks_of_crowded(rows.filter("_crowded"), visits, crowded, per_lane, mark, lanes, bits))

    order = Window.partitionBy(*group).orderBy("mark", "section_order", "piece_time", "piece_id", "view")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_piece = F.col("mark") == PIECE
    opens = is_piece & (F.col("section") != "") & ~F.lag("section_order").over(order).eqNullSafe(F.col("section_order"))
    placed = rows.drop("_crowded").unionByName(marks).withColumn("opens", opens)
    steps = {
        f"n{k}": F.sum(F.when(F.col("mark") == BEGIN, F.get("at", F.lit(k))).when(
            is_piece & (F.col("reads").bitwiseAND(bit) != 0), F.when(F.col("opens"), 2).otherwise(1)).otherwise(0)).over(so_far)
        for k, bit in enumerate(bits)}
    placed = placed.withColumns({**steps, "copies": F.first("copies").over(so_far)}).filter(F.col("copies").isNotNull())

    # What a row shows is chosen from whole lists too: nothing, pieces, pieces below a title, words for views without pieces.
    def shown(*forms: int) -> list[Column]:
        return [F.array(*(F.lit(form + STAGES.index(s)) for form in forms for s in names)).cast("array<int>") for names in READ_BY.values()]

    lists = F.array(*shown(AS_PIECE), *shown(AS_TITLE, AS_PIECE), *shown(AS_MISSING))
    absent = sum((F.when(F.col(f"n{k}") == 0, bit).otherwise(0) for k, bit in enumerate(bits)), F.lit(0)).bitwiseAND(F.col("reads"))
    which = F.when(is_piece, F.when(F.col("opens"), 8).otherwise(0) + F.col("reads")).when(F.col("mark") == END, 16 + absent).otherwise(0)
    items = F.get(lists, which)
    # A visit that is listed twice has its views twice.
    items = F.when(F.col("copies") == 1, items).otherwise(F.flatten(F.array_repeat(items, F.col("copies"))))
    each = placed.select("vid", "section", "view", *steps, F.explode(items).alias("item"))
    form, place = F.floor(F.col("item") / 10) * 10, F.col("item") % 10
    number = F.when(place == 0, F.col("n0")).when(place == 1, F.col("n1")).otherwise(F.col("n2"))
    missing = F.array(F.lit(fixed.NO_DISCHARGE), F.lit(fixed.NO_STAGE2), F.lit(fixed.NO_STAGE3))
    return each.select(
        "vid", F.get(F.array(*(F.lit(s) for s in STAGES)), place).alias("stage"),
        F.when(form == AS_PIECE, number).when(form == AS_TITLE, number - 1).otherwise(1).cast("bigint").alias("part"),
        F.when(form == AS_PIECE, F.col("view")).when(form == AS_TITLE, F.col("section")).otherwise(F.get(missing, place)).alias("view"))


def _marks_of_crowded(
    rows: DataFrame, visits: DataFrame, crowded: Crowd, per_lane: Callable, mark: Callable, lanes: list[str], bits: list[int],
) -> DataFrame:
    """What the chunks of crowded visits begin with, from a count per chunk; the end of a visit is a chunk of its own."""
    few = F.broadcast(crowded.only(visits))
    names = [f"n{k}" for k in range(len(bits))]
    counts = rows.groupBy("vid", *lanes, "_piece", "_chunk", "section_order", "section").agg(
        *(F.sum((F.col("reads").bitwiseAND(bit) != 0).cast("bigint")).alias(n) for n, bit in zip(names, bits)))
    ends = per_lane(few).select(
        "vid", *lanes, F.lit(0).alias("_piece"), F.lit(2**62).alias("_chunk"), F.lit(None).cast("int").alias("section_order"),
        F.lit("").alias("section"), *(F.lit(0).cast("bigint").alias(n) for n in names), F.lit(True).alias("is_end"))
    every = counts.withColumn("is_end", F.lit(False)).unionByName(ends)
    goes_on = F.row_number().over(Window.partitionBy("vid", *lanes, "section_order").orderBy("_chunk")) > 1
    every = every.withColumn("goes_on", goes_on)
    titled = ~F.col("goes_on") & (F.col("section") != "")
    before = Window.partitionBy("vid", *lanes).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    at = F.array(*(F.coalesce(F.sum(F.col(n) + F.when(titled & (F.col(n) > 0), 1).otherwise(0)).over(before), F.lit(0)) for n in names))
    every = every.withColumn("first", at).join(few, "vid")
    kinds = F.when(F.col("is_end"), F.array(F.lit(BEGIN), F.lit(END))).otherwise(F.array(F.lit(BEGIN)))
    every = every.withColumn("kind", F.explode(kinds))
    return mark(every, F.col("kind"), F.when(F.col("goes_on"), F.col("section_order")), F.when(F.col("kind") == BEGIN, F.col("first")))
