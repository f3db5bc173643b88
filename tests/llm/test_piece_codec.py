import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from chartloom.llm import piece_codec as op

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁▁a", "\n", "a\n\nb\tc", "éèß ñ", "日本語 テキスト", "ﬁ​́x", "\x00\x01", "😀👩‍👩‍👧", "<s> </s> <unk> <0x0A>", "w" * 500, "thethe" * 300, " ".join("abc") * 200, "a" * 47, "a" * 48]


@pytest.fixture(scope="module")
def pieces():
    return op.Pieces(MODEL)


def test_agendas_agree_with_the_library(pieces):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcde ▁thin.,'\n éß日😀") for _ in range(rng.randrange(80))) for _ in range(2000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text, ids in zip(texts, pieces.encode(texts)):
        assert ids.tolist() == library.encode(text), text
        assert [i for s in pieces.segments(text) for i in pieces.agenda(s)] == ids.tolist()


def test_forgetting_changes_nothing(pieces, monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 50)
    for k in range(5):
        texts = [f"word{k}{i} other{i} common" for i in range(40)]
        assert [i.tolist() for i in pieces.encode(texts)] == pieces.library.encode(texts)


def test_rows_match_the_library(documents):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (0, ODD[0]), (100, "long " * 50_000)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = op.encode(documents(rows), MODEL, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert op.encode(documents([]), MODEL).count() == 0
