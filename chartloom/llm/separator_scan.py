"""Token counts from flat token files by a scan for separators.

A flat file is nothing but token ids, two bytes each, with an end-of-document id
after every document and no index. Files are cut into blocks of a fixed number
of tokens; a task reads its block's bytes alone, finds the separators with one
vector comparison, and gives the places inside the block. What happens before a
block (documents so far, tokens since the last separator) comes from a prefix
scan over one narrow row per block, so a document may span any number of blocks.

Defined results: two neighbouring separators are a document of no tokens; what
follows the last separator of a file is a last document that is not ended
(``ended`` is false); an empty file has no document. ``write_flat``: a null or
empty text has no token before its separator; repeated rows are written
repeatedly; an empty table makes no file; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.llm.shared import pieces, shared_folder, stored, tasks_for, texts_of

#: Tokens of a block.
BLOCK = 1 << 20
KIND = np.dtype("<u2")
#: Separator of the queries: the id that the vocabulary leaves free.
END = 50256


def write_flat(docs: DataFrame, ranks: str, pattern: str, folder: str, end: int = END) -> DataFrame:
    """Write one flat file per task. Returns what was written: file, n_bytes, and ordinal and doc_id of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        task, sink, ordinal = TaskContext.get(), None, 0
        name = f"{folder}/flat-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        separator = np.array([end], KIND).tobytes()
        for whole in batches:
            for part in pieces(whole, 8 << 20):
                if not part.num_rows:
                    continue
                if sink is None:
                    if folder.startswith("file:"):
                        pa.fs.LocalFileSystem().create_dir(folder.removeprefix("file://"))
                    system, path = pa.fs.FileSystem.from_uri(name)
                    sink = system.open_output_stream(path)
                for text in part.column("text").to_pylist():
                    sink.write(np.array(encoder.encode_ordinary(text), KIND).tobytes() + separator)
                ids = part.column("doc_id")
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([name] * len(ids)), "ordinal": pa.array(range(ordinal, ordinal + len(ids)), pa.int64()), "doc_id": ids,
                })
                ordinal += len(ids)
        if sink is not None:
            sink.close()

    return stored(texts_of(docs).mapInArrow(run, "file string, ordinal long, doc_id long"), folder, "written")


def blocks_of(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, block) rows for the files' sizes. Sizes are asked for in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names = part.column("file").to_pylist()
            sizes = []
            for name in names:
                system, path = pa.fs.FileSystem.from_uri(name)
                sizes.append(system.get_file_info(path).size)
            yield pa.RecordBatch.from_pydict({"file": names, "n_bytes": pa.array(sizes, pa.int64())})

    sized = files.select("file").mapInArrow(run, "file string, n_bytes long")
    tokens = F.floor(F.col("n_bytes") / KIND.itemsize)
    return sized.filter(tokens > 0).select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((tokens - 1) / block))).alias("block"))


def scan(blocks: DataFrame, end: int = END, block: int = BLOCK) -> DataFrame:
    """For each block: n_tokens and the places of its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file, number in zip(part.column("file").to_pylist(), part.column("block").to_pylist(), strict=True):
                system, path = pa.fs.FileSystem.from_uri(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(block * KIND.itemsize, number * block * KIND.itemsize)
                ids = np.frombuffer(data[: len(data) // KIND.itemsize * KIND.itemsize], KIND)
                found = np.flatnonzero(ids == end).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "file": [file], "block": [number], "n_tokens": [len(ids)], "places": pa.array([found], pa.list_(pa.int64())),
                })

    return blocks.mapInArrow(run, "file string, block long, n_tokens long, places array<long>")


def stitch(scanned: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document, across blocks."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("block") * block
    last = F.when(F.size("places") > 0, first + F.element_at("places", -1) + 1)
    # The scan sees one narrow row per block; the places stay in the stored table.
    carried = scanned.select(
        "file", "block",
        F.coalesce(F.sum(F.size("places").cast("long")).over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.max(last).over(before), F.lit(0)).alias("open_since"),
    )
    placed = scanned.join(carried, ["file", "block"]).select("file", "docs_before", "open_since", first.alias("first"), "places", F.posexplode("places").alias("k", "place"))
    ended = placed.select(
        "file", (F.col("docs_before") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("open_since")).otherwise(F.col("first") + F.get("places", F.col("k") - 1) + 1).alias("start"),
        (F.col("first") + F.col("place")).alias("stop"),
    ).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    whole = scanned.groupBy("file").agg(
        F.max(first + F.col("n_tokens")).alias("stop"), F.sum(F.size("places").cast("long")).alias("ordinal"), F.coalesce(F.max(last), F.lit(0)).alias("start")
    )
    rest = whole.filter("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def count_tokens(files: DataFrame, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """Documents of the named flat files, found by their separators."""
    blocks = stored(blocks_of(files, block), folder, "blocks")
    spread = blocks.repartition(tasks_for(blocks.count()))
    return stitch(stored(scan(spread, end, block), folder, "scanned"), block)


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: they are written to flat files, and the counts come from the files alone.

    The writer's list of ordinals adds the doc_id.
    """
    import public_tokenizers

    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = write_flat(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, folder)
    counted = count_tokens(written.select("file").distinct(), folder)
    return counted.join(written, ["file", "ordinal"]).select("doc_id", "ordinal", "start", "n_tokens", "ended")
