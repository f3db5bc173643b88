"""CSV files with line breaks in cells, read by many tasks.

The text source hands a file out in byte ranges, here called blocks, as lines.
Whether a line starts inside a quoted cell depends on everything before it. So
a first pass reduces each block to what it does to a reader that enters it
outside or inside a cell: the state it leaves in, the rows that start, and the
text of the rows that cross its ends. A prefix scan over the blocks of a file
composes these, which gives every block its true state and first row number.
The second pass cuts each block into rows. A row that crosses blocks is put
together from the texts of the first pass; no other text is shuffled unless
the table of blocks is too large for Spark to broadcast.

Cells are parted by commas. A cell that begins with a quote ends at the next
single quote; doubled quotes stand for one. Quotes elsewhere are plain text.
Lines end with a line feed, with or without a carriage return. Blank lines
between rows are skipped, and every file starts with its header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.session import reliable_checkpoint
from chartloom.sources import tables

_INSIDE = r'(?:[^"]|"")*+'
_OPEN = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?,)*+"{_INSIDE}'
#: A line that starts outside a cell and ends inside one; one that starts inside a cell and ends inside one.
OPENS = re.compile(_OPEN)
STAYS = re.compile(rf'{_INSIDE}(?:"[^,]*+,{_OPEN})?')

BLOCK = ["file", "start", "length"]
SUMMARY = "file string, start long, length long, " + ", ".join(
    f"{side}_leaves boolean, {side}_rows long, {side}_head string, {side}_tail string" for side in ("out", "in"))


class Cutter:
    """Cuts the lines of a block into rows, entered outside or inside a cell."""

    def __init__(self, inside: bool):
        self.inside = self.entered = inside
        self.rows = 0
        self.head: str | None = None
        self.lines: list[str] = []

    def feed(self, lines: list[str]) -> Iterator[str]:
        """Rows that start and end in the block, in order. ``rows`` also counts the one left open."""
        for line in lines:
            quoted = '"' in line
            if self.inside:
                self.lines.append(line)
                if quoted and not STAYS.fullmatch(line):
                    self.inside = False
                    whole, self.lines = "\n".join(self.lines), []
                    if self.entered and self.head is None:
                        self.head = whole
                    else:
                        yield whole
            elif quoted or line.strip():
                self.rows += 1
                if quoted and OPENS.fullmatch(line):
                    self.inside = True
                    self.lines = [line]
                else:
                    yield line

    def ends(self) -> tuple[bool, int, str | None, str | None]:
        """State behind the block, rows that started, and the texts of the rows that cross its ends."""
        left = "\n".join(self.lines) if self.inside else None
        if self.entered and self.head is None:
            return self.inside, self.rows, left, None
        return self.inside, self.rows, self.head, left


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    value = F.col("value") if encoding == "UTF-8" else tables.decoded(F.col("value"), encoding)
    return spark.read.option("lineSep", "\n").text(path).select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_block_length").alias("length"), F.monotonically_increasing_id().alias("line"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that belong to one block."""
    starts, files = batch.column("start").to_pylist(), batch.column("file").to_pylist()
    at = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] != starts[at] or files[i] != files[at]:
            yield at, i
            at = i


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block; a task sees its blocks one after the other."""
    names = [part.split()[0] for part in SUMMARY.split(", ")]
    block, cutters = None, []

    def row() -> pa.RecordBatch:
        values = [*block, *cutters[0].ends(), *cutters[1].ends()]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.bool_(), pa.int64(), pa.string(), pa.string()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        for low, high in _stretches(batch):
            here = tuple(batch.column(name)[low].as_py() for name in BLOCK)
            if here != block:
                if block:
                    yield row()
                block, cutters = here, [Cutter(False), Cutter(True)]
            lines = batch.column("value").slice(low, high - low).to_pylist()
            for cutter in cutters:
                for _ in cutter.feed(lines):
                    pass
    if block:
        yield row()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that lie in one block, with their number in the file."""
    block, cutter, number = None, Cutter(False), 0
    for batch in batches:
        files, numbers, texts = [], [], []
        for low, high in _stretches(batch):
            here = tuple(batch.column(name)[low].as_py() for name in BLOCK)
            if here != block:
                block, cutter = here, Cutter(batch.column("inside")[low].as_py())
                number = batch.column("first_row")[low].as_py()
            for text in cutter.feed(batch.column("value").slice(low, high - low).to_pylist()):
                files.append(here[0])
                # The row just finished is the last one that started.
                numbers.append(number + cutter.rows - 1)
                texts.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["file", "row", "text"])


def block_states(summaries: DataFrame) -> DataFrame:
    """State and first row number of every block: the prefix scan over what blocks do.

    A block that leaves in the same state however it is entered forgets what was
    before; the others keep the state or turn it. So the state is that of the last
    forgetful block, turned as often as blocks since then turn it.
    """
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col("out_leaves") & ~F.col("in_leaves"), 1).otherwise(0)
    narrow = summaries.select(*BLOCK, "out_leaves", "in_leaves", "out_rows", "in_rows").withColumn("turned", F.sum(turns).over(upto))
    forgets = F.when(F.col("out_leaves") == F.col("in_leaves"), F.struct(F.col("out_leaves").alias("state"), "turned"))
    known = narrow.withColumn("base", F.last(forgets, ignorenulls=True).over(before)).withColumn(
        "so_far", F.coalesce(F.lag("turned").over(Window.partitionBy("file").orderBy("start")), F.lit(0)))
    flips = (F.col("so_far") - F.coalesce("base.turned", F.lit(0))) % 2 == 1
    states = known.withColumn("inside", F.coalesce("base.state", F.lit(False)) != flips)
    rows = F.when(F.col("inside"), F.col("in_rows")).otherwise(F.col("out_rows"))
    return states.withColumn("rows", rows).withColumn("first_row", F.coalesce(F.sum("rows").over(before), F.lit(0))).select(
        *BLOCK, "inside", "rows", "first_row")


def csv_rows(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Every row of the files as text: ``file, row, text``; the header is row 0."""
    lines = _lines(spark, path, encoding)
    summaries = reliable_checkpoint(lines.mapInArrow(_summaries, SUMMARY))
    states = reliable_checkpoint(block_states(summaries))
    placed = lines.join(states, BLOCK, "left")
    # Blocks follow from the session's cores; a block unknown to the first pass must not be guessed.
    same = F.when(F.col("first_row").isNull(), F.raise_error(F.lit("the file was split anew between two passes; read it again"))).otherwise(F.col("first_row"))
    # Order is lost if Spark shuffles for the join; otherwise the rows are sorted already.
    within = placed.withColumn("first_row", same.cast("bigint")).sortWithinPartitions("file", "start", "line").mapInArrow(_rows, "file string, row long, text string")
    sides = summaries.join(states, BLOCK).select("file", "start", F.explode(F.array(
        F.struct((F.col("first_row") - 1).alias("row"), F.when(F.col("inside"), F.col("in_head")).alias("part")),
        F.struct((F.col("first_row") + F.col("rows") - 1).alias("row"), F.when(F.col("inside"), F.col("in_tail")).otherwise(F.col("out_tail")).alias("part")),
    )).alias("s")).filter("s.part IS NOT NULL")
    # A row has as many parts as blocks it touches, and fits in memory as a row.
    crossing = sides.groupBy("file", "s.row").agg(F.array_sort(F.collect_list(F.struct("start", "s.part"))).alias("parts")).select(
        "file", "row", F.array_join("parts.part", "\n").alias("text"))
    return within.unionByName(crossing)


def read_split_csv(spark: SparkSession, path: str, strict_width: bool = False, encoding: str | None = None, source_row: str | None = None) -> DataFrame:
    """Text columns as ``tables.read_csv`` gives them, in no particular order.

    ``source_row`` names a column for the number of the row in its file; the
    first row after the header is 2. With ``strict_width`` a row whose width
    differs from the header is an error when the table is read.
    """
    encoding = encoding or tables.csv_encoding(spark, path)
    names = tables.csv_header(spark, path, encoding)
    schema = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST" if strict_width else "PERMISSIVE"}
    rows = csv_rows(spark, path, encoding).filter("row > 0")
    parsed = rows.select("row", F.from_csv(F.rtrim("text", F.lit("\r")), F.lit(schema), options).alias("cells"))
    numbered = [(F.col("row") + 1).alias(source_row)] if source_row else []
    return parsed.select(*numbered, "cells.*")
