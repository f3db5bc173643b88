"""Text column functions. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed

# Unicode meaning of \s, \d, \w and \b.
UNICODE = "(?U)"


# Every white-space character.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.trim(text, F.lit(WHITE))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    Spark copies the definition of a projected column into later filters and
    projections. For long expressions that multiplies the generated code, so
    they are kept behind a generator, which nothing is merged into.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(UNICODE + r"\S")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, UNICODE + r"\s+", " ")


EDGE = r"\b"


def _branches(pattern: str) -> list[str]:
    """The pattern cut at the bars that stand in no group or set."""
    parts, depth, in_set, start = [], 0, False, 0
    for found in re.finditer(r"\\.|[\[\]()|]", pattern):
        char = found[0]
        if in_set or char == "[":
            in_set = char != "]"
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:found.start()])
            start = found.end()
    return [*parts, pattern[start:]]


def _first_group(branch: str) -> str:
    """What is in the group that a branch starts with, when the group cannot be left out."""
    depth = 0
    for found in re.finditer(r"\\.|\[(?:\\.|[^\]\\])+\]|[()]", branch):
        depth += (found[0] == "(") - (found[0] == ")")
        if depth == 0:
            inner = branch[1:found.start()].removeprefix("?:")
            return "" if inner.startswith("?") or branch[found.end():found.end() + 1] in ("?", "*", "{") else inner
    return ""


def first_letters(pattern: str) -> str:
    """Letters and digits one of which every match starts with; empty when that is not certain."""
    letters = set()
    for branch in _branches(pattern):
        while branch.startswith(EDGE):
            branch = branch.removeprefix(EDGE)
        if branch.startswith("("):
            inner = _first_group(branch)
            first = first_letters(inner) if inner else ""
        else:
            plain = re.match(r"([a-z0-9])(?![?*{])", branch)
            first = plain[1] if plain else ""
        if not first:
            return ""
        letters |= set(first)
    return "".join(sorted(letters))


def quick(pattern: str) -> str:
    """The same pattern that looks at the first letter of a match before anything else.

    The edge of a word in all languages costs far more to test than a letter, and
    it is tested at each place of a text once for every branch that starts with it.
    """
    if "\\Q" in pattern or re.search(r"\(\?[a-zA-Z]", pattern):
        return pattern
    branches = _branches(pattern)
    if len(branches) > 1 and all(b.startswith(EDGE) for b in branches):
        pattern = EDGE + "(?:" + "|".join(b.removeprefix(EDGE) for b in branches) + ")"
    letters = first_letters(pattern)
    return f"(?=[{letters}])(?:{pattern})" if letters else pattern


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    """True when one of the patterns is found; one regex pass."""
    flagged = any(re.search(r"\(\?[a-zA-Z]", p) for p in patterns)
    return text.rlike(UNICODE + ("|".join(f"(?:{p})" for p in patterns) if flagged else quick("|".join(patterns))))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(text: Column, pattern: str, use) -> Column:
    """``use(start, end)`` of the first match, by code points; null without one.

    One split gives what is before and after the match, so the text is searched
    once. The pattern must not match the empty text.
    """
    def places(parts: Column) -> Column:
        place = F.struct(
            F.length(parts[0]).alias("start"), (F.length(text) - F.length(parts[1])).alias("end")
        )
        return F.when(F.size(parts) == 2, let(place, lambda p: use(p["start"], p["end"])))

    return let(F.split(text, UNICODE + quick(pattern), 2), places)


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Plain substring tests, much cheaper than a pattern."""
    found = F.lit(False)
    for part in dict.fromkeys(parts):
        found = found | F.contains(text, F.lit(part))
    return found


def needed_text(pattern: str) -> str:
    """A piece of plain text that every match of the pattern contains.

    Groups, escapes and optional characters are left out; what remains between
    them must be in the match. Empty when nothing is certain.
    """
    bare = re.sub(r"\\.", " ", pattern)
    while re.search(r"\([^()]*\)", bare):
        bare = re.sub(r"\([^()]*\)[?*+]?", " ", bare)
    if "|" in bare:
        return ""
    bare = re.sub(r"\[[^\]]*\][?*+]?|[a-z0-9]?[?*]|[a-z0-9]\{[^}]*\}", " ", bare)
    return max(re.findall("[a-z0-9]+", bare), key=len, default="")


def window(text: Column, start: Column, end: Column) -> Column:
    """``text[max(start, 0):end]`` by code points."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """The match with 50 characters before and 70 after it, dots where cut."""
    low = F.greatest(start - 50, F.lit(0))
    high = end + 70
    body = strip(window(text, low, high))
    return F.concat(
        F.when(low > 0, "...").otherwise(""),
        body,
        F.when(high < F.length(text), "...").otherwise(""),
    )


# What each of the date shapes starts with. It is cheap to see, the edge of a word in all languages is not.
DATE_STARTS = (r"(?=\d)", "(?=[0-9])", "(?=[JFMASONDjfmasond\u017f][AEPUCOaepuco][NBRYLGPTVCnbrylgptvc])")


def scrub_dates(text: Column) -> Column:
    """Calendar dates become ``[DATE REDACTED]``."""
    for start, shape in zip(DATE_STARTS, fixed.DATE_SHAPES, strict=True):
        text = F.regexp_replace(text, UNICODE + start + shape, fixed.DATE_REDACTED)
    return text


def plain_text(text: Column, gap: str = " ") -> Column:
    """Tags removed, the common entities decoded, white space squeezed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"</?[A-Za-z][^>]*>", gap)
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
        ("&nbsp;", "\u00a0"), ("&deg;", "\u00b0"), ("&micro;", "\u00b5"), ("&ge;", "\u2265"),
        ("&le;", "\u2264"), ("&amp;", "&"),
    ):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip(squeeze(bare))


def unquoted(quote: Column) -> Column:
    """A quote as it is looked up: without outer dots and quotation marks, lower case, one space between words."""
    bare = strip(F.coalesce(quote, F.lit("")))
    for char in (r"\.", '"', "'"):
        bare = F.regexp_replace(bare, f"^{char}+|{char}+$", "")
    bare = F.lower(squeeze(bare))
    return strip(F.regexp_replace(F.regexp_replace(bare, r"^\.\.\.", ""), r"\.\.\.$", ""))


TOKEN = r"[a-z0-9.]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def quote_grounded(quote: Column, chart: Column) -> Column:
    """Is the quote in the chart, or are three quarters of its longer words?

    Repeated words of the quote count each time they occur.
    """
    def partly(words: Column, known: Column) -> Column:
        found = F.size(F.filter(words, lambda word: F.array_contains(known, word)))
        return F.when(F.size(words) == 0, False).otherwise(found / F.size(words) >= 0.75)

    def long_words(wanted: Column) -> Column:
        return F.filter(tokens(wanted), lambda word: F.length(word) >= 3)

    def test(wanted: Column, whole: Column) -> Column:
        by_words = let(
            F.struct(long_words(wanted).alias("words"), F.array_distinct(tokens(whole)).alias("known")),
            lambda t: partly(t["words"], t["known"]),
        )
        return F.when(F.length(wanted) < 4, False).when(F.contains(whole, wanted), True).otherwise(by_words)

    both = F.struct(unquoted(quote).alias("wanted"), F.lower(squeeze(chart)).alias("whole"))
    blank = (F.coalesce(quote, F.lit("")) == "") | (F.coalesce(chart, F.lit("")) == "")
    return F.when(blank, False).otherwise(let(both, lambda t: test(t["wanted"], t["whole"])))


def quote_verbatim(quote: Column, chart: Column) -> Column:
    """Exact substring after squeezing white space."""
    return F.contains(strip(squeeze(chart)), strip(squeeze(quote)))


def safe_cell(text: Column, keep_negative_numbers: bool = True) -> Column:
    """A cell that a spreadsheet will not read as a formula."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    bare = F.regexp_replace(value, UNICODE + r"^\s+", "")
    risky = bare.rlike(r"^[=+\-@]")
    if keep_negative_numbers:
        risky = risky & ~bare.rlike(r"^-\d+(\.\d+)?$")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def short_number(value: Column) -> Column:
    """Up to six significant digits, no trailing zeros."""
    size = F.abs(value)
    rounded = F.when(size >= 1e5, F.round(value, 0))
    for digits, low in ((1, 1e4), (2, 1e3), (3, 1e2), (4, 1e1), (5, 1.0), (6, 0.1), (7, 0.01)):
        rounded = rounded.when(size >= low, F.round(value, digits))
    text = rounded.otherwise(F.round(value, 9)).cast("decimal(28,9)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def plain_number(value: Column) -> Column:
    """A number as text without an exponent, which a reader could take for a value of its own."""
    digits = F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"(\.\d+?)0+$", "$1")
    usual = (value == 0) | F.abs(value).between(1e-3, 9999999)
    return F.when(usual, value.cast("string")).otherwise(F.coalesce(digits, value.cast("string")))


def text_digest(text: Column) -> Column:
    """A number per row whose sum over any rows, in any order, is a digest of them all."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def highlight_spans(body: Column, quotes: Column, keyword: Column) -> Column:
    """Marked spans of a note: quotes first found, every keyword, no overlaps.

    Spans are sorted by start, the longer first, and a span that begins inside
    a kept one is dropped. The result is an array of (start, end, kind).
    """
    span = "struct<start:int,end:int,kind:string>"

    def make(start: Column, size: Column, kind: str) -> Column:
        return F.struct(
            start.cast("int").alias("start"), (start + size).cast("int").alias("end"), F.lit(kind).alias("kind")
        )

    def literal(text: Column) -> Column:
        return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")

    def quote_span(low: Column, quote: Column) -> Column:
        words = F.filter(F.split(quote, UNICODE + r"\s+"), lambda word: word != "")
        loose = F.concat(F.lit("(?is)"), F.array_join(F.transform(words, literal), r"\s+"))
        found = F.when(F.size(words) >= 3, let(F.regexp_substr(body, loose), lambda hit: F.when(
            hit.isNotNull(), make(F.position(hit, body) - 1, F.length(hit), "quote"))))
        return F.when(F.length(quote) < 6, F.lit(None)).otherwise(let(
            F.position(F.lower(quote), low), lambda at: F.when(at > 0, make(at - 1, F.length(quote), "quote")).otherwise(found)))

    def quote_spans(low: Column) -> Column:
        return F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")),
                                    lambda raw: let(strip(raw), lambda quote: quote_span(low, quote))),
                        lambda item: item.isNotNull())

    def key_spans(low: Column, key: Column) -> Column:
        # A keyword starts after the pieces and keywords before it; one walk over the pieces adds them up.
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

        def step(walk: Column, piece: Column) -> Column:
            at = walk["at"] + F.length(piece)
            return F.struct(
                (at + F.length(key)).alias("at"), F.concat(walk["spans"], F.array(make(at, F.length(key), "keyword"))).alias("spans"))

        every = let(F.split(low, literal(F.lower(key))), lambda pieces: F.when(
            F.size(pieces) > 1, F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda walk: walk["spans"])))
        return F.coalesce(F.when(F.length(key) >= 2, every), F.array().cast(f"array<{span}>"))

    # The whole text is lowered and cut once; a column that several expressions name is computed for each of them.
    spans = let(F.lower(body), lambda low: F.concat(
        quote_spans(low), let(strip(F.coalesce(keyword, F.lit(""))), lambda key: key_spans(low, key))))
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda item: F.struct(
                item["start"].alias("start"), (-(item["end"] - item["start"])).alias("shorter"),
                item["end"].alias("end"), item["kind"].alias("kind"),
            ),
        )
    )
    return F.aggregate(
        ordered,
        F.array().cast(f"array<{span}>"),
        lambda kept, item: F.when(
            (F.size(kept) == 0) | (item["start"] >= F.element_at(kept, -1)["end"]),
            F.concat(kept, F.array(F.struct(item["start"].alias("start"), item["end"].alias("end"),
                                            item["kind"].alias("kind")))),
        ).otherwise(kept),
    )
