"""Coded answers, numbers, dates and statuses as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom import fixed_values as fixed
from chartloom.functions.text import UNICODE, let, strip


def _low(value: Column) -> Column:
    return F.lower(strip(value.cast("string")))


def gate_code(value: Column) -> Column:
    """Three-way answer as "1", "2" or "3"; null when blank or unknown."""
    low, code = _low(value), F.lit(None).cast("string")
    for answer, spellings in fixed.GATE_SPELLINGS.items():
        code = F.when(low.isin(*spellings), answer).otherwise(code)
    return code


def yes_no(value: Column) -> Column:
    """Two-valued answer as boolean; null when blank or unknown."""
    low = _low(value)
    return F.when(low.isin(*fixed.BINARY_TRUE), True).when(low.isin(*fixed.BINARY_FALSE), False)


def resolved_gate(gate: Column, follow_up: Column) -> Column:
    """The gate answer; an unsure one is decided by its follow-up."""
    first, second = gate_code(gate), gate_code(follow_up)
    return (
        F.when(first == "1", True)
        .when(first == "2", False)
        .when((first == "3") & (second == "1"), True)
        .when((first == "3") & (second == "2"), False)
    )


def culture_positive(value: Column) -> Column:
    low = _low(value)
    return F.when(low == "", None).when(low.isin(*fixed.CULTURE_FALSE), False).when(low.isNotNull(), True)


def organism_tokens(value: Column) -> Column:
    """Distinct words that can name an organism."""
    bare = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\(\+\)|\(\-\)|\+", " ")
    words = F.regexp_extract_all(bare, F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*fixed.ORGANISM_IGNORED_WORDS))
    )


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two token sets; null when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union)


def first_number(value: Column) -> Column:
    """First signed decimal in the text."""
    return F.regexp_extract(value.cast("string"), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def number_list(value: Column) -> Column:
    """The first number of each part between commas or semicolons."""
    parts = F.transform(F.split(value.cast("string"), "[,;]+"), first_number)
    return F.filter(parts, lambda number: number.isNotNull())


def clock_minutes(value: Column) -> Column:
    """``H:MM`` or ``HH:MM[:SS]`` as minutes of the day."""
    text, shape = strip(value.cast("string")), r"^(\d{1,2}):(\d{2})(?::\d{2})?$"
    hour = F.regexp_extract(text, shape, 1).try_cast("int")
    minute = F.regexp_extract(text, shape, 2).try_cast("int")
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def discrepancy_category(field: Column) -> Column:
    return (
        F.when(field.isin("sepsis_ync_v3", "sepsis_uncertain_v3", "gate_resolved"), "gate_classification_mismatch")
        .when(field.startswith("sep1_v3"), "sirs_criterion_mismatch")
        .when(field.startswith("sep_surg_v3"), "surgical_trauma_confounder_mismatch")
        .when(field.isin("sep3_v3", "sep3_v3_positive", "sep4_v3"), "infection_or_antibiotic_mismatch")
        .when(field.isin("sep6_v3", "sep7_v3"), "organ_dysfunction_or_lactate_mismatch")
        .when(field.isin("sep_day_v3", "sep_days", "sep_dt_v3"), "onset_timing_mismatch")
        .otherwise("field_mismatch")
    )


def status_code(value: Column) -> Column:
    """A status in any accepted spelling; blank means indeterminate.

    An unknown spelling is returned upper-cased, so that a check can refuse it.
    """
    upper = F.upper(strip(value.cast("string")))
    key = F.regexp_replace(upper, UNICODE + r"[\s\-/]+", "_")
    code = upper
    for status, spellings in fixed.STATUS_SPELLINGS.items():
        code = F.when(key.isin(*spellings), status).otherwise(code)
    return F.when(F.coalesce(upper, F.lit("")) == "", fixed.INDETERMINATE).otherwise(code)


def confidence(value: Column) -> Column:
    """A score in [0, 1]; percentages are scaled, anything else is 0.5."""
    number = F.regexp_replace(strip(value.cast("string")), "%+$", "").try_cast("double")
    scaled = F.when((number > 1) & (number <= 100), number / 100).otherwise(number)
    return F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)))


def note_number(value: Column) -> Column:
    """The first run of digits; null for booleans and text without digits."""
    text = value.cast("string")
    whole = text.try_cast("double").try_cast("bigint")
    digits = F.regexp_extract(text, r"\d+", 0).try_cast("bigint")
    return F.when(F.lower(text).isin("true", "false", "nan"), None).otherwise(F.coalesce(whole, digits))


def is_present(status: Column) -> Column:
    return status.isin(fixed.POSITIVE, fixed.PROBABLE)


# Date shapes and the ISO form that the cast reads; a two-digit year from 69 on is of the last century.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAME = (
    r"^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
)
#: Words that say nothing about the moment: weekdays, ordinal endings, joints, zones.
SILENT_WORD = r"^(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?|st|nd|rd|th|of|at|t|z|utc|gmt)$"
ISO_TIME = r"^\d{4}-\d{2}-\d{2}(?:[ Tt]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"
#: A clock time with an optional half of the day and zone, or a bare hour with a half.
CLOCK = (
    r"(?:\b|(?<=t))(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?\s*(?:([ap])\.?m\b\.?)?\s*(?:z\b|utc\b|gmt\b|[+-]\d{2}:?\d{2}\b)?"
    r"|\b(\d{1,2})\s*([ap])\.?m\b\.?"
)


def lenient_timestamp(value: Column) -> Column:
    """A timestamp without zone, or null. The offset of a zoned text is dropped.

    A text is split into its clock time and the numbers and words of its date,
    whatever stands between them. A month's name takes the month's place; a number
    of four digits is the year; otherwise the year comes last and the month first,
    unless that number is above 12, which makes it the day. Two-digit years are
    1969 to 2068; a missing day is the first. Numbers of 8, 12 and 14 digits hold
    a date, and a time behind it. Any other word makes the text unreadable.
    """
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(ISO_TIME), text.try_cast("timestamp_ntz")).otherwise(let(F.lower(text), _by_grammar))


def _by_grammar(text: Column) -> Column:
    date = F.regexp_replace(text, CLOCK, " ")
    words = F.regexp_extract_all(date, F.lit(r"([a-z]+|\d+)"), F.lit(1))
    told = F.filter(words, lambda w: ~w.rlike(SILENT_WORD))
    fit = date.rlike(r"^[a-z0-9\s,./'-]*$") & (F.length(text) <= 64)
    return F.when(fit, let(told, lambda w: _resolved(text, w)))


def _resolved(text: Column, words: Column) -> Column:
    names = F.filter(words, lambda w: w.rlike("^[a-z]"))
    numbers = F.filter(words, lambda w: ~w.rlike("^[a-z]"))
    return let(
        F.struct(names.alias("names"), numbers.alias("numbers")),
        lambda s: F.when(
            (F.size(s["names"]) == 0) | ((F.size(s["names"]) == 1) & F.get(s["names"], F.lit(0)).rlike(MONTH_NAME)),
            _moment(text, F.get(s["names"], F.lit(0)), s["numbers"]),
        ),
    )


def _moment(text: Column, name: Column, numbers: Column) -> Column:
    first, second, third, fourth = (F.get(numbers, F.lit(k)) for k in range(4))
    size, wide, packed = F.size(numbers), F.length(first) == 4, F.length(first).isin(8, 12, 14)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(name, 1, 3)).cast("string")
    one = F.lit("1")
    day_first = first.try_cast("int") > 12

    def row(year: Column, month: Column, day: Column, rest: Column) -> Column:
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), rest.alias("rest"))

    nothing = F.lit(None).cast("string")
    date = (
        F.when(name.isNotNull() & (size == 1) & wide, row(first, month, one, nothing))
        .when(name.isNotNull() & (size >= 2), F.when(wide, row(first, month, second, third)).otherwise(row(second, month, first, third)))
        .when(name.isNull() & packed & (size <= 2), row(
            F.substring(first, 1, 4), F.substring(first, 5, 2), F.substring(first, 7, 2),
            F.coalesce(F.when(F.length(first) > 8, F.substring(first, 9, 6)), second)))
        .when(name.isNull() & (size >= 3) & wide, row(first, second, third, fourth))
        .when(name.isNull() & (size >= 3), F.when(day_first, row(third, second, first, fourth)).otherwise(row(third, first, second, fourth)))
        .when(name.isNull() & (size == 2) & wide, row(first, second, one, nothing))
        .when(name.isNull() & (size == 2) & (F.length(second) == 4), row(second, first, one, nothing))
        .when(name.isNull() & (size == 1) & wide, row(first, one, one, nothing))
    )
    spare = F.when(name.isNull() & packed, 2).when(name.isNull(), 4).otherwise(3)
    clock = {k: F.regexp_extract(text, CLOCK, k) for k in range(1, 8)}
    half = F.concat(clock[5], clock[7])
    said = F.concat(clock[1], clock[6])

    def whole(d: Column) -> Column:
        short = F.length(d["y"]) == 2
        year = F.when(short, F.concat(F.when(d["y"].try_cast("int") < 69, "20").otherwise("19"), d["y"])).when(F.length(d["y"]) == 4, d["y"])
        digits = F.when(d["rest"].rlike(r"^(?:\d{4}|\d{6})$"), d["rest"])
        hour = F.coalesce(F.when(said != "", said), F.substring(digits, 1, 2), F.lit("0")).try_cast("int")
        hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        minute = F.coalesce(F.when(clock[2] != "", clock[2]), F.when(said == "", F.substring(digits, 3, 2)), F.lit("00"))
        second_ = F.coalesce(F.when(clock[3] != "", clock[3]), F.when(said == "", F.when(F.length(digits) == 6, F.substring(digits, 5, 2))), F.lit("00"))
        left_over = d["rest"].isNotNull() & (digits.isNull() | (said != ""))
        iso = F.concat(
            year, F.lit("-"), F.lpad(d["m"], 2, "0"), F.lit("-"), F.lpad(d["d"], 2, "0"), F.lit(" "),
            F.lpad(hour24.cast("string"), 2, "0"), F.lit(":"), minute, F.lit(":"), second_, F.substring(clock[4], 1, 7),
        )
        fits = (F.length(d["m"]) <= 2) & (F.length(d["d"]) <= 2) & ~left_over & (size <= spare)
        return F.when(fits, iso.try_cast("timestamp_ntz"))

    return let(date, whole)


def has_clock_time(value: Column) -> Column:
    return F.coalesce(value.cast("string").rlike(r"\d{1,2}:\d{2}"), F.lit(False))


def day_offset(moment: Column, anchor: Column) -> Column:
    """Calendar days from the anchor."""
    return F.datediff(moment, anchor)


def seconds_between(start: Column, end: Column) -> Column:
    """Wall-clock seconds between two timestamps without zone, in any session zone."""

    def of_day(moment: Column) -> Column:
        return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.extract(F.lit("SECOND"), moment).cast("double")

    return day_offset(end, start) * 86400 + of_day(end) - of_day(start)


def offset_label(moment: Column, anchor: Column) -> Column:
    """``Day +2 14:05``, ``Time 14:05`` without anchor, or unknown."""
    clock, days = F.date_format(moment, "HH:mm"), day_offset(moment, anchor)
    sign = F.when(days >= 0, "+").otherwise("")
    return (
        F.when(moment.isNull(), "Offset unknown")
        .when(anchor.isNull(), F.concat(F.lit("Time "), clock))
        .otherwise(F.concat(F.lit("Day "), sign, days.cast("string"), F.lit(" "), clock))
    )


def visit_key(value: Column) -> Column:
    """Ids as text: ``20001.0`` and ``20001`` are the same visit."""
    written = value.cast("string")
    text = strip(written)
    # From a plain whole number there is nothing to take away, and it is cheap to see.
    return F.when(written.try_cast("bigint").cast("string") == written, written).when(
        text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def confounder_codes(codes: Column) -> Column:
    """Affirmative codes 1-3 win over 9 (unclear), which wins over 4 (no)."""
    seen = F.array_distinct(F.filter(F.transform(codes, strip), lambda c: c.isin("1", "2", "3", "4", "9")))
    yes = F.filter(seen, lambda c: c.isin("1", "2", "3"))
    return (
        F.when(F.size(yes) > 0, yes)
        .when(F.array_contains(seen, "9"), F.array(F.lit("9")))
        .when(F.array_contains(seen, "4"), F.array(F.lit("4")))
        .otherwise(F.array(F.lit("9")))
    )


def condition_concept(condition: Column) -> Column:
    code = F.lit(fixed.DEFAULT_CONDITION_CONCEPT)
    for name, concept in fixed.CONDITION_CONCEPTS.items():
        code = F.when(condition == name, concept).otherwise(code)
    return code


def status_concept(status: Column) -> Column:
    code = F.lit(fixed.DEFAULT_STATUS_CONCEPT)
    for name, concept in fixed.STATUS_CONCEPTS.items():
        code = F.when(status == name, concept).otherwise(code)
    return code


def criteria_key(condition: Column) -> Column:
    """Configuration key of a condition name; the first fragment found wins."""
    low, key = F.lower(condition), F.lit(None).cast("string")
    for fragment, name in reversed(fixed.CRITERIA_FRAGMENTS):
        key = F.when(F.contains(low, F.lit(fragment)), name).otherwise(key)
    return key
