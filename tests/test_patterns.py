"""Patterns that look at the first letter first find what they found before."""

import re

from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions import text
from chartloom.operators import abstraction, rules


def test_first_letters():
    assert text.first_letters(r"\bno\s+x") == "n" and text.first_letters(r"\b(?:ab|s/p\s+(?:c|d))|xy") == "asx"
    assert text.first_letters(r"s?now") == "" and text.first_letters(r"(?:a|b)?c") == "" and text.first_letters(r"a{0,2}b") == ""
    assert text.first_letters(r"\s*a") == "" and text.first_letters("a|[bc]") == "" and text.first_letters("(?=a)b") == ""
    assert text.quick(r"\Qa[b|c\E") == r"\Qa[b|c\E" and text.quick("(?i)ab") == "(?i)ab"
    assert text.quick(r"\bab|\bcd") == r"(?=[ac])(?:\b(?:ab|cd))"


def test_quick_finds_the_same(spark):
    sets = [*(r.negative for r in rules.RULES.values()), fixed.GENERIC_NEGATIVE, *([p] for p in abstraction.SIGNALS.values()),
            *([rules.bounded(p)] for r in rules.RULES.values() for p in r.positive), [abstraction.INFECTION]]
    words = sorted({w for s in sets for p in s for w in re.findall(r"[a-z]+|\d+", p)})
    lines = [" ".join(words[(7 * k + j * j * (k % 5 + 1)) % len(words)] for j in range(6)) for k in range(300)]
    lines += ["no sepsis", "xno sepsis", "éno sepsis", "no  evidence of sepsis", "38.4 fever", "138.4", "hr 118", "rule out septic", ""]
    df = spark.createDataFrame([(x,) for x in lines], "low string")
    for patterns in sets:
        old = F.col("low").rlike(text.UNICODE + "|".join(f"(?:{p})" for p in patterns))
        assert df.filter(~old.eqNullSafe(text.matches_any(F.col("low"), patterns))).isEmpty(), patterns


def test_touched_hits(spark):
    notes = spark.createDataFrame([(1, 1, "a\nno sepsis\nSepsis")], "visit_occurrence_id long, note_id long, note_text string")
    hits = rules.touched_hits(notes, list(rules.RULES.values()), ("visit_occurrence_id", "note_id"))
    assert [r.hit.evidence_quote for r in hits.collect() if r.hit] == ["Sepsis"]
