import random
import statistics

import pytest
from pyspark.sql import functions as F

from chartloom.functions import values
from chartloom.operators import agreement, intervals
from chartloom.plans import registry

SHAPES = {
    "13/02/2024": "2024-02-13 00:00:00", "02/13/2024": "2024-02-13 00:00:00", "02/03/2024": "2024-02-03 00:00:00",
    "12-31-2024 10:00": "2024-12-31 10:00:00", "05.01.2024": "2024-05-01 00:00:00", "25.01.2024 7:05": "2024-01-25 07:05:00",
    "20240105101500": "2024-01-05 10:15:00", "202401051015": "2024-01-05 10:15:00", "20240105": "2024-01-05 00:00:00",
    "20240105T101500": "2024-01-05 10:15:00", "5 Jan 24": "2024-01-05 00:00:00", "Jan 2024": "2024-01-01 00:00:00",
    "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00", "January 5th, 2024 at 3:07 pm": "2024-01-05 15:07:00",
    "5-JAN-2024 12:30 AM": "2024-01-05 00:30:00", "1/5/24 3 p.m.": "2024-01-05 15:00:00", "2024/1/5": "2024-01-05 00:00:00",
    "2024-01-05T10:15:30.25Z": "2024-01-05 10:15:30.25", "2024-01-05 10:15:30+05:30": "2024-01-05 10:15:30",
    "2024 Jan 5": "2024-01-05 00:00:00", "2024-01": "2024-01-01 00:00:00", "01/2024": "2024-01-01 00:00:00", "2024": "2024-01-01 00:00:00",
    "1/5/69": "1969-01-05 00:00:00", "10:15 1/5/2024": "2024-01-05 10:15:00", "2024-01-05": "2024-01-05 00:00:00",
}
UNREAD = (
    None, "", " ", "not a time", "nan", "32/32/2024", "2024-02-30", "13/13/2024", "Foo 5 2024", "1/5/2024 25:00", "1/5/2024 13:00 pm", "12", "123456",
    "5 Jan", "1 2 3 4 5 6", "1/5/2024;x", "20001.0.0.0", "x" * 9000, "Jan Feb 2024",
)


def test_dates_by_grammar(spark):
    written = [*SHAPES, *UNREAD]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(written)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", values.lenient_timestamp(F.col("t")).cast("string").alias("v")).collect()}
    wrong = {t: got[i] for i, t in enumerate(written) if got[i] != SHAPES.get(t)}
    assert not wrong


def test_days_in_intervals_of_any_length(spark):
    rng = random.Random(2)
    spans = []
    for key in "abc":
        for _ in range(12):
            first = rng.randrange(-60, 60)
            spans.append((key, first, first + rng.choice([-3, 0, 1, 2, 5, 17, 40])))
    # Ends in the years 2099 and 9999, and one before its start.
    spans += [("d", 3, 28_000), ("e", -5, 2_913_000), ("f", 4, 3), ("g", None, 4), ("h", 4, None)]
    days = [(k, d, d * 2) for k in "abcdefghz" for d in (*range(-70, 110), 28_000, 28_001, 2_913_000, 2_913_001)]
    made = spark.createDataFrame(spans, "vid string, first_day int, last_day int")
    asked = spark.createDataFrame(days + days[:3], "vid string, day int, extra int")
    found = intervals.days_in_intervals(asked, made, ["vid"], "first_day", "last_day")
    inside = lambda k, d: any(v == k and None not in (a, b) and a <= d <= b for v, a, b in spans)
    assert sorted(map(tuple, found.collect())) == sorted(r for r in days + days[:3] if inside(r[0], r[1]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
    blocks = made.filter("last_day >= first_day").select(F.size(intervals.aligned_blocks(F.col("first_day"), F.col("last_day"))).alias("n"))
    assert blocks.agg(F.max("n")).first()[0] <= 2 * intervals.LEVELS


@pytest.mark.parametrize("rows", [
    [1.0], [2.0, 1.0], [1e300, 1.0, 2.0, 3.0, -1e300], [0.5] * 50 + [1e300] * 49, [float(k % 977) for k in range(6000)] + [1e300, -1e-300],
])
def test_median_does_not_depend_on_the_spread_of_values(spark, rows):
    shuffled = random.Random(1).sample(rows, len(rows))
    table = spark.createDataFrame([(v,) for v in shuffled] + [(None,)], "v double")
    assert agreement.median_of(table, "v").first().median == pytest.approx(statistics.median(rows))


def test_a_far_value_does_not_put_the_others_in_one_range(spark):
    rows = [float(k) for k in range(20_000)] + [1e300]
    plan = agreement.median_of(spark.createDataFrame([(v,) for v in rows], "v double"), "v", levels=5)
    assert plan.first().median == 10_000.0


def test_query_names_are_not_taken_twice():
    registry.register(name="only_once")(lambda spark, folder: None)
    try:
        with pytest.raises(ValueError, match="only_once"):
            registry.register(name="only_once")(lambda spark, folder: None)
    finally:
        del registry.QUERIES["only_once"]
