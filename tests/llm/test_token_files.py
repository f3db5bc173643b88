import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from chartloom.llm import token_files as op
from chartloom.llm.shared import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "A  b\n\nC\td", "don't we'll 12a3", "éÉ é ́x", "日本語 テキスト", "\x1c\x85  　x", "<|endoftext|> a<|startoftext|>b <|x|>", "### $$$ a#b", "ΑΣ ΑΣΑ İ", "😀 👩‍👩‍👧 'S 'ſ", " x y"]


def test_words_encode_as_whole_texts(monkeypatch):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("abC 'sdl,.!#<|>\n\té́ß日9") for _ in range(rng.randrange(60))) for _ in range(3000)]
    words = op.Words(PATH)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    split = lambda t: [x.tolist() for x in (lambda ids, stops: np.split(ids, stops[:-1]))(*words.encode(pa.array(t, pa.string())))]
    assert split(texts) == want
    monkeypatch.setattr(op, "REMEMBERED", 20)
    for start in range(0, 300, 30):
        assert split(texts[start : start + 30]) == want[start : start + 30]


def test_files_round_trip(spark, documents):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "first"), (500, None), (3, ODD[3]), (600, "long word " * 9000), (-5, "minus")]
    rows += [(1000 + i, "some words here " * (i % 7)) for i in range(200)]
    folder = shared_folder(spark)
    manifest = op.write_files(documents(rows), PATH, folder, length=64, batch=4)
    got = sorted(op.read_documents(manifest).collect(), key=lambda r: r.start)
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    # Random access: sequences of the first file are views with equal length.
    first = manifest.orderBy("place").first()
    reader = op.open_file(first.file)
    taken = [op.sequence(reader, k) for k in range(sum(reader.get_batch(b).num_rows for b in range(reader.num_record_batches)))]
    assert {len(i) for i, _ in taken} == {64} and sum(m.sum() for _, m in taken) == first.tokens
    assert reader.schema.field("ids").type == pa.list_(pa.uint16(), 64)


def test_empty_table(spark, documents):
    assert op.read_documents(op.write_files(documents([]), PATH, shared_folder(spark))).count() == 0
