import base64
import pathlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chartloom.llm import separator_scan as op
from chartloom.llm.shared import shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def brute(ids, end):
    out, start, n = [], 0, 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((n, start, i - start, True))
            start, n = i + 1, n + 1
    return out + ([(n, start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 3, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = random.Random(block)
    files, want = [], []
    for name, ids in {
        "a": [rng.choice([7, 7, 7, 9]) for _ in range(200)], "b": [9, 9, 9], "c": [], "d": [1] * 70, "e": [1] * 64 + [9], "f": [9] + [1] * 130 + [9, 2],
    }.items():
        path = pathlib.Path(tmp_path) / name
        path.write_bytes(np.array(ids, op.KIND).tobytes())
        files.append((f"file://{path}",))
        want += [(f"file://{path}", *r) for r in brute(ids, 9)]
    got = op.count_tokens(spark.createDataFrame(files, "file string"), shared_folder(spark), 9, block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_counts_match_the_tokenizer(spark, documents):
    rows = [(i, t) for i, t in enumerate(["", "one two", "é" * 50, "x " * 30_000, "a\nb"])] + [(None, "null id"), (7, None), (1, "one two")]
    folder = shared_folder(spark)
    written = op.write_flat(documents(rows), RANKS, public_tokenizers.PATTERN, folder)
    counted = op.count_tokens(written.select("file").distinct(), folder, block=1000)
    got = counted.join(written, ["file", "ordinal"]).select("doc_id", "n_tokens", "ended").collect()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = [(i, len(library.encode_ordinary(t or "")), True) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = op.write_flat(documents([]), RANKS, public_tokenizers.PATTERN, shared_folder(spark))
    assert op.count_tokens(empty.select("file").distinct(), shared_folder(spark)).count() == 0
