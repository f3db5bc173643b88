"""Fixed-length token sequences in Arrow files.

A file holds record batches of ``BATCH`` sequences. ``ids`` and ``mask`` are
fixed-size lists of equal length, so sequence i is a slice of one buffer in a
memory-mapped file, without a copy; the mask is false on the padding of the
last sequence. ``ends`` names the documents that end in a sequence and where.
Files are written by one task each under a name with the task's attempt, and
only names in the manifest that Spark commits count, so a lost executor leaves
at most an unused file.

Documents are dealt to files by ranges of doc_id, so that the files in order
hold ascending doc_ids; equal doc_ids are ordered by a hash of the text. A
document's words are encoded once and remembered up to a fixed number. This is
exact, because the tokenizer splits at spaces before merging; a tokenizer that
does not is refused.

Defined results: a null or empty text has the end id alone; a null doc_id comes
first; repeated rows are written repeatedly; an empty table makes no file and
no row; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartloom.llm.shared import pieces, shared_folder, stored, tasks_for, texts_of

LENGTH = 2048
BATCH = 64
END = 2
#: Remembered words of one Python worker.
REMEMBERED = 400_000
#: Bytes of text that are encoded at once.
PIECE = 4 << 20
#: New words that the library encodes at once.
LINE = 2000
#: Letters that no normalisation joins or parts, then ASCII marks but the apostrophe: at most one word each.
PLAIN = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)\z"


class Words:
    """A tokenizer with a memory of words and of their plain parts."""

    def __init__(self, path: str) -> None:
        with open(path) as file:
            parts = json.load(file)
        steps = parts["pre_tokenizer"].get("pretokenizers", [parts["pre_tokenizer"]])
        if not (steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")):
            raise ValueError("this tokenizer does not drop white space before merging")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        suffix = parts["model"]["end_of_word_suffix"]
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(self.library.get_vocab_size(), bool)  # tokens that end a word
        for token, i in self.library.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def remembered(self, parts: list[str], plain: bool) -> list[bytes]:
        """Ids of words; new ones are encoded by the library. A plain word is letters alone or marks alone."""
        new = [w for w in parts if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = parts
        again = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        if len(again) < len(new):
            new = [w for w in new if w not in self.known]
            # A few words at a time, as the library's results are many times as large as the ids.
            for k in range(0, len(new), LINE):
                part = new[k : k + LINE]
                if plain:
                    # Each is one word to the tokenizer, so that a line of them is taken apart at the ends of words.
                    ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
                    stops = np.flatnonzero(self.last[ids]) + 1
                    if len(stops) != len(part):
                        raise ValueError("a line was not encoded word by word")
                    data, ends = ids.tobytes(), (stops * self.kind.itemsize).tolist()
                    self.known.update((w, data[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
                else:
                    whole = self.library.encode_batch_fast(part, add_special_tokens=False)
                    self.known.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(part, whole, strict=True))
        return [self.known[w] for w in parts]

    def spelled(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words in a row, and the number of ids of each."""
        parts = pc.extract_regex(names, PLAIN)
        odd = pc.is_null(parts)
        slots, made = [], []
        for field in ("letters", "marks"):
            coded = pc.dictionary_encode(pc.utf8_lower(pc.fill_null(pc.struct_field(parts, field), "")))
            slots.append(coded.indices.to_numpy().astype(np.int64) + len(made))
            listed = coded.dictionary.to_pylist()
            found = iter(self.remembered([w for w in listed if w], True))
            made += [next(found) if w else b"" for w in listed]
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(where):
            slots[0][where] = np.arange(len(where)) + len(made)
            made += self.remembered(names.take(pa.array(where)).to_pylist(), False)
        ids = np.frombuffer(b"".join(made), self.kind)
        size = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
        both = np.stack(slots, 1).ravel()
        return gathered(ids, size, both), size[both].reshape(-1, 2).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids end."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(pc.list_flatten(cut))
        ids, size = self.spelled(coded.dictionary)
        used = coded.indices.to_numpy()
        stops = np.cumsum(size[used])
        words = np.cumsum(pc.list_value_length(cut).to_numpy())
        return gathered(ids, size, used), np.where(words > 0, np.append(stops, 0)[words - 1], 0)


@cache
def words_of(path: str) -> Words:
    """One tokenizer for all tasks of a Python worker; what it remembers is bounded."""
    return Words(path)


def gathered(ids: np.ndarray, size: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The stretches of ``ids`` with the given sizes, taken in the order of ``used``."""
    sizes = size[used]
    start = np.cumsum(size) - size
    return ids[np.repeat(start[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]


def schema(kind: pa.DataType, length: int) -> pa.Schema:
    end = pa.struct([("at", pa.int32()), ("doc_id", pa.int64())])
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(end))])


class Writer:
    """Packs documents into sequences and writes full batches."""

    def __init__(self, url: str, kind: np.dtype, length: int, batch: int) -> None:
        system, path = pa.fs.FileSystem.from_uri(url)
        self.sink = system.open_output_stream(path)
        self.kind, self.length, self.rows = kind, length, batch
        self.schema = schema(pa.from_numpy_dtype(kind), length)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = 0  # tokens that wait
        self.ends: list[tuple[int, int | None]] = []  # place among the waiting tokens, doc_id
        self.tokens = self.docs = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, stops: np.ndarray) -> None:
        """Add documents that lie in a row in ``ids`` and end before ``stops``."""
        self.ends += zip((stops + (self.held - 1)).tolist(), doc_ids, strict=True)
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.docs += len(doc_ids)
        if self.held >= self.rows * self.length:
            self.flush(self.held // (self.rows * self.length) * self.rows)

    def flush(self, sequences: int) -> None:
        """Write ``sequences`` sequences; those beyond the waiting tokens are padded."""
        flat = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        take = sequences * self.length
        now, self.waiting = flat[:take], [flat[take:]]
        real = np.arange(take) < len(now)
        now = np.concatenate([now, np.zeros(take - len(now), self.kind)]).astype(self.kind)
        here = [e for e in self.ends if e[0] < take]
        self.ends = [(a - take, d) for a, d in self.ends[len(here) :]]
        self.held = max(0, self.held - take)
        lists: list[list[dict]] = [[] for _ in range(sequences)]
        for a, d in here:
            lists[a // self.length].append({"at": a % self.length, "doc_id": d})
        for start in range(0, sequences, self.rows):
            stop = min(start + self.rows, sequences)
            span = slice(start * self.length, stop * self.length)
            self.file.write_batch(pa.record_batch([
                pa.FixedSizeListArray.from_arrays(pa.array(now[span]), self.length),
                pa.FixedSizeListArray.from_arrays(pa.array(real[span]), self.length),
                pa.array(lists[start:stop], self.schema.field("ends").type),
            ], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.flush(-(-self.held // self.length))
        self.file.close()
        self.sink.close()


def write_files(docs: DataFrame, tokenizer: str, folder: str, end: int = END, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """Write the files; return their manifest: place in the order, file, documents, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        writer = None
        task = TaskContext.get()
        name = f"{folder}/tokens-{task.partitionId():06d}-{task.taskAttemptId()}.arrow"
        for whole in batches:
            for part in pieces(whole, PIECE):
                if not part.num_rows:
                    continue
                if writer is None:
                    if folder.startswith("file:"):
                        pa.fs.LocalFileSystem().create_dir(folder.removeprefix("file://"))
                    writer = Writer(name, words.kind, length, batch)
                flat, stops = words.encode(part.column("text"))
                writer.add(part.column("doc_id").to_pylist(), np.insert(flat, stops, words.kind.type(end)), stops + np.arange(1, len(stops) + 1))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"place": [task.partitionId()], "file": [name], "docs": [writer.docs], "tokens": [writer.tokens]})

    texts = texts_of(docs).withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = texts.repartitionByRange("doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "row")
    return stored(ordered.select("doc_id", "text").mapInArrow(run, "place long, file string, docs long, tokens long"), folder, "manifest")


def open_file(url: str) -> pa.ipc.RecordBatchFileReader:
    """A reader with random access to batches; local files are mapped, not read."""
    system, path = pa.fs.FileSystem.from_uri(url)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(system, pa.fs.LocalFileSystem) else system.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence. The ids are a view of the file's buffer."""
    rows = reader.get_batch(0).num_rows
    batch = reader.get_batch(number // rows)
    at = number % rows
    ids, mask = batch.column("ids"), batch.column("mask")
    length = ids.type.list_size
    return (
        ids.values.slice(at * length, length).to_numpy(zero_copy_only=True),
        mask.values.slice(at * length, length).to_numpy(zero_copy_only=False),
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # One narrow row per file; the text and the ids stay in the tasks.
    files = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).select("file", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file, start in zip(part.column("file").to_pylist(), part.column("before").to_pylist(), strict=True):
                reader = open_file(file)
                begun, at, crc = start, start, 0  # start of the open document, tokens read, its checksum so far
                for k in range(reader.num_record_batches):
                    batch = reader.get_batch(k)
                    mask = batch.column("mask").values.to_numpy(zero_copy_only=False)
                    ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[mask].astype("<u4")
                    length = batch.column("ids").type.list_size
                    made: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    done = 0
                    for row, ends in enumerate(batch.column("ends").to_pylist()):
                        for e in ends:
                            stop = row * length + e["at"] + 1
                            crc = zlib.crc32(ids[done:stop], crc)
                            for column, value in zip(made.values(), (e["doc_id"], begun, at + stop - begun, crc), strict=True):
                                column.append(value)
                            begun, done, crc = at + stop, stop, 0
                    crc = zlib.crc32(ids[done:], crc)
                    at += len(ids)
                    yield pa.RecordBatch.from_pydict(made, pa.schema([(c, pa.int64()) for c in made]))

    return files.repartition(tasks_for(manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_files(docs, public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark)))
