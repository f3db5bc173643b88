"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols of one character each. An agenda of adjacent pairs,
ordered by the score of the piece they form and then from the left, is worked
off until no pair forms a piece; characters that are no piece fall back to
bytes. Pieces never hold a space mark behind another character, and no line end
(both checked when the model is read), so a text is cut before each run of
space marks and each line end, and each segment is encoded once per batch and
remembered up to a fixed number. Short
segments share one agenda in numpy, which takes the best pair of every segment
in each step; long ones have a heap. All new segments of an Arrow batch are
checked against the sentencepiece library, and a difference stops the job.
Decoding is the library's.

Defined results: a null or empty text has no token and decodes to the empty
text; repeated rows give repeated results; further columns are ignored by
``encode`` and kept by the files of the caller.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from chartloom.llm.shared import batches_of, texts_of

SPACE = "▁"
#: Remembered segments of one Python worker; as many more that were in use before are kept as well.
REMEMBERED = 300_000
KIND = np.dtype("<i4")
#: Characters of a segment up to which the shared agenda is used.
SHORT = 48
NONE = np.int64(1) << 40


class Pieces:
    """A merge-type model: pieces, scores and the pairs that form a piece."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, size = self.library, self.library.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        for piece in plain:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece holds a space mark behind another character")
            if "\n" in piece:
                raise ValueError("a piece holds a line end")
        self.size = size
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.symbol = np.arange(0x110000, dtype=np.int64) + size  # a character that is no piece
        for piece, i in plain.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.width = np.int64(size + 0x110000)
        forms: dict[int, int] = {}
        known = {p: i for p, i in plain.items()}
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                a = known.get(left, int(self.symbol[ord(left)]) if cut == 1 else None)
                b = known.get(right, int(self.symbol[ord(right)]) if len(piece) - cut == 1 else None)
                if a is not None and b is not None:
                    forms[a * int(self.width) + b] = i
        scores = np.array([sp.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1]  # higher score, lower rank
        self.forms = {k: (int(rank[i]), i) for k, i in forms.items()}
        # Symbols that are in some pair get small numbers, so that a pair fits 32 bits; number 0 is in none.
        members = sorted({m for k in forms for m in divmod(k, int(self.width))})
        self.number = np.zeros(size + 0x110000, np.int32)
        self.number[members] = np.arange(1, len(members) + 1)
        self.many = len(members) + 1
        if self.many**2 >= 1 << 31:
            raise ValueError("too many pieces")
        keys = np.array(sorted(forms), np.int64)
        small = self.number[keys // self.width] * np.int32(self.many) + self.number[keys % self.width]
        order = np.argsort(small)
        self.pairs = small[order]
        self.made = np.array([forms[int(k)] for k in keys[order]], np.int64)
        self.rank = np.append(rank[self.made].astype(np.int64), NONE)
        self.digits = [str(i) for i in range(size)]
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """The text cut before each run of spaces and each line end.

        A segment that begins with a space mark is given without its first one, so it never begins with a line end.
        """
        if not text:
            return []
        if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        cut = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE))
        return [s.removeprefix(SPACE) for s in cut]

    @staticmethod
    def marked(segment: str) -> str:
        """The segment with its space mark."""
        return segment if segment.startswith("\n") else SPACE + segment

    def spelled(self, symbols: list[int]) -> tuple[int, ...]:
        if max(symbols, default=0) < self.size:
            return tuple(symbols)
        return tuple(chain.from_iterable([s] if s < self.size else (self.byte[b] for b in chr(s - self.size).encode()) for s in symbols))

    def agenda(self, segment: str) -> tuple[int, ...]:
        """One segment, with a heap of pairs by rank and place."""
        symbols = [int(self.symbol[ord(c)]) for c in self.marked(segment)]
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        width, heap = int(self.width), []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (form := self.forms.get(symbols[i] * width + symbols[j])):
                heapq.heappush(heap, (form[0], i, j, symbols[i], symbols[j], form[1]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, left, right, piece = heapq.heappop(heap)
            if symbols[i] != left or symbols[j] != right or after[i] != j:
                continue
            symbols[i], symbols[j] = piece, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self.spelled([s for s in symbols if s >= 0])

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; the last place stands for none."""
        key = self.number[left] * np.int32(self.many) + self.number[right]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), at, len(self.pairs))

    def shared_agenda(self, segments: list[str]) -> list[bytes]:
        """Many segments of similar length at once; each step merges the best pair of each."""
        whole = [self.marked(s) for s in segments]
        lengths = np.array([len(s) for s in whole])
        symbols = np.full((len(segments), int(lengths.max()) + 1), -1, np.int64)
        codes = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        symbols[np.arange(symbols.shape[1])[None, :] < lengths[:, None]] = self.symbol[codes]
        place = self.looked_up(symbols[:, :-1], symbols[:, 1:])
        none = len(self.pairs)
        active = np.arange(len(segments))
        columns = np.arange(symbols.shape[1])
        while len(active):
            best = self.rank[place[active]].argmin(1)
            found = place[active, best]
            going = found < none
            active, best, found = active[going], best[going], found[going]
            if not len(active):
                break
            rows, ways = symbols[active], place[active]
            shift = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), len(columns) - 1)
            rows = np.take_along_axis(rows, shift, 1)
            rows[:, -1] = -1
            line = np.arange(len(active))
            rows[line, best] = self.made[found]
            ways = np.take_along_axis(ways, np.minimum(shift[:, :-1], ways.shape[1] - 1), 1)
            ways[:, -1] = none
            ways[line, best] = self.looked_up(rows[line, best], rows[line, best + 1])
            before = np.maximum(best - 1, 0)
            inner = best > 0
            ways[line[inner], before[inner]] = self.looked_up(rows[line[inner], before[inner]], rows[line[inner], best[inner]])
            symbols[active], place[active] = rows, ways
        size = (symbols >= 0).sum(1)
        flat = symbols[symbols >= 0]
        data, stops = flat.astype(KIND).tobytes(), (np.cumsum(size) * KIND.itemsize).tolist()
        out = [data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        for k in np.flatnonzero((symbols >= self.size).any(1)).tolist():
            out[k] = np.array(self.spelled(symbols[k][symbols[k] >= 0].tolist()), KIND).tobytes()
        return out

    def learn(self, segments: set[str]) -> None:
        """Encode new segments, check them against the library, and remember them."""
        found: dict[str, bytes] = {}
        short = sorted((s for s in segments if len(s) < SHORT), key=len)
        for start in range(0, len(short), 4096):
            part = short[start : start + 4096]
            found.update(zip(part, self.shared_agenda(part), strict=True))
        for s in segments:
            if len(s) >= SHORT:
                found[s] = np.array(self.agenda(s), KIND).tobytes()
        names = [s for s in found if s]
        # The library puts a space mark before every text; before a line end it is a token of its own.
        theirs = self.library.encode(names, num_threads=1)
        theirs = [t[1:] if s[0] == "\n" else t for s, t in zip(names, theirs, strict=True)]
        same = b"".join(map(found.__getitem__, names)) == np.fromiter(chain.from_iterable(theirs), KIND).tobytes()
        if not same or any(len(found[s]) != KIND.itemsize * len(t) for s, t in zip(names, theirs, strict=True)):
            raise ValueError("a segment is encoded differently by the sentencepiece library")
        self.ids.update(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.segments(t) for t in texts]
        every: set[str] = set()
        for c in cut:
            every.update(c)
        new = every.difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED:
            self.older, self.ids = self.ids, {}
            new = every
        if new:
            again = new.intersection(self.older)
            self.ids.update((s, self.older[s]) for s in again)
            if len(again) < len(new):
                self.learn(new - again)
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, c)), KIND) for c in cut]


@cache
def pieces_of(path: str) -> Pieces:
    """One model for all tasks of a Python worker; what it remembers is bounded."""
    return Pieces(path)


def _coded(path: str, listed: bool, texts: bool):
    def rows(batch: pa.RecordBatch) -> dict:
        pieces = pieces_of(path)
        ids = [i.tolist() for i in pieces.encode(batch.column("text").to_pylist())]
        back = pieces.library.decode(ids, num_threads=1) if ids else []
        return {
            "doc_id": batch.column("doc_id"),
            **({"ids": pa.array(ids, pa.list_(pa.int32()))} if listed else {}),
            "n_tokens": [len(i) for i in ids],
            "ids_sha256": [hashlib.sha256(",".join(map(pieces.digits.__getitem__, i)).encode()).hexdigest() for i in ids],
            **({"decoded": back} if texts else {}),
            "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
        }

    return rows


def encode(docs: DataFrame, model: str, *columns: str) -> DataFrame:
    """The named columns of: doc_id, ids, n_tokens, ids_sha256, decoded, decoded_sha256."""
    kinds = {"doc_id": "long", "ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
    names = columns or tuple(kinds)
    return batches_of(texts_of(docs), _coded(model, "ids" in names, "decoded" in names), ", ".join(f"{c} {kinds[c]}" for c in names), 4 << 20)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
