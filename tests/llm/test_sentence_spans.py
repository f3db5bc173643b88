import random

from chartloom.llm import sentence_spans as op


def brute(rows):
    """Removed sentences by comparing the words of all spans."""
    seen, out = {}, []
    keys = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc in keys:
        text = doc[1] or ""
        ranges = op.sentence_ranges(text)
        counts = [len(text[a:b].split()) for a, b in ranges]
        gone = set()
        for i in range(len(counts)):
            j = i + 1
            while j <= len(counts) and (j - i < op.SENTENCES or sum(counts[i:j]) < op.WORDS):
                j += 1
            if j <= len(counts):
                key = " ".join(w for a, b in ranges[i:j] for w in text[a:b].split())
                if key in seen and seen[key] != (doc, i):
                    gone |= set(range(i, j))
                seen.setdefault(key, (doc, i))
        out.append((doc[0], len(gone)))
    count = {r: rows.count(r) for r in keys}
    return sorted((o for o, k in zip(out, keys) for _ in range(count[k])), key=str)


def test_sentences_by_hand(monkeypatch):
    monkeypatch.setattr(op, "EVERY", 1)
    short = "One two. Three!\nfour\tfive\n\n  six"
    assert [short[a:b] for a, b in op.sentence_ranges(short)] == ["One two.", "Three!", "four\tfive", "six"]
    long = " ".join(f"w{i}" for i in range(op.LONG + 1))
    assert len(op.sentence_ranges(long)) == op.LONG + 1 and op.sentence_ranges(" \n") == []


def sentence(rng, low=2, high=14):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(low, high))) + rng.choice([".", "!", ".\n"])


def test_removed_sentences_match_brute_force(documents):
    rng = random.Random(8)
    passages = [" ".join(sentence(rng) for _ in range(8)) for _ in range(3)] + [" ".join(f"v{rng.randrange(900)}" for _ in range(80))]
    rows = [(1, None), (2, ""), (3, "one."), (None, passages[0]), (5, passages[0] + " " + passages[0])]
    for i in range(30):
        rows.append((100 - i, " ".join([*(sentence(rng) for _ in range(rng.randrange(6))), rng.choice(passages), *(sentence(rng) for _ in range(3))])))
    rows += [rows[6], rows[6], (200, rows[7][1])]
    got = op.repeats(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == brute(rows)


def test_a_passage_of_over_fifty_words_goes_from_all_but_one(documents):
    rng = random.Random(9)
    for trial in range(3):
        kind = [lambda: " ".join(sentence(rng, 3, 20) for _ in range(9)), lambda: " ".join(f"z{trial}q{rng.randrange(900)}" for _ in range(60)), lambda: " ".join(f"z{rng.randrange(900)}***" for _ in range(55))][trial]
        passage = kind()
        rows = [(i, f"clean{i} " + sentence(rng) + f" and glued{i} " + passage + f" tail{i} " + sentence(rng)) for i in range(12)]
        rows += [(50 + i, " ".join(sentence(rng) for _ in range(10))) for i in range(10)]
        got = {r.doc_id: r for r in op.repeats(documents(rows)).collect()}
        assert [got[i].n_removed > 0 for i in range(12)] == [False] + [True] * 11
        assert all(got[50 + i].n_removed == 0 and got[50 + i].text == dict(rows)[50 + i] for i in range(10))
        assert all(f"clean{i}" in got[i].text and len(got[i].text.split()) < 60 for i in range(1, 12))


def test_cut_keeps_columns_and_empty_tables_work(documents):
    text = " ".join(f"w{i}{'.' if i % 7 == 6 else ''}" for i in range(70))
    docs = documents([(1, text), (2, text), (3, None)])
    out = op.cut(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == text and texts[2].strip() == "" and texts[3] is None
    assert op.repeats(documents([])).count() == 0
