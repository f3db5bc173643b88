"""Merging treatment intervals into episodes, and the days they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.values import seconds_between


def merge_episodes(
    intervals: DataFrame,
    key: str = "vid",
    gap_hours: float = 24,
    trough_gap_hours: float = 48,
) -> DataFrame:
    """Episodes of intervals that follow each other closely.

    Input: ``key``, ``start_time``, ``end_time``, ``is_trough``, ``ref``. Sorted
    by start, an interval joins the running episode when the gap to the latest
    end so far is at most ``gap_hours``, or ``trough_gap_hours`` when it or any
    earlier interval of the episode is a trough drug.

    Intervals of one key that start on the same day always join (their gap is
    under a day), so they are first combined per day, before the shuffle. What
    is left has at most one row per key and day, whatever the number of
    intervals. On those rows a gap above ``trough_gap_hours`` always breaks.
    Between two such breaks an episode that has met a trough drug goes on to the
    end, so a smaller gap breaks only before the first trough drug.
    """
    if gap_hours < 24:
        raise ValueError("intervals starting on one day are combined, so gap_hours must be at least 24")
    end = F.greatest("end_time", "start_time")
    first = F.min(F.struct("start_time", "ref", "is_trough"))
    days = (
        intervals.groupBy(key, F.to_date("start_time").alias("day"))
        .agg(first.alias("first"), F.max(end).alias("end_time"), F.bool_or("is_trough").alias("any_trough"),
             F.count(F.lit(1)).alias("parts"))
        .select(key, F.col("first.start_time").alias("start_time"), "end_time",
                F.col("first.is_trough").alias("first_trough"), "any_trough", F.col("first.ref").alias("ref"), "parts")
    )
    earlier = Window.partitionBy(key).orderBy("start_time").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("start_time").rowsBetween(Window.unboundedPreceding, 0)
    gap = _hours(F.max("end_time").over(earlier), F.col("start_time"))
    hard = days.withColumn("gap", gap).withColumn(
        "stretch", F.sum(F.when(F.col("gap") <= trough_gap_hours, 0).otherwise(1)).over(upto)
    )
    before = Window.partitionBy(key, "stretch").orderBy("start_time").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(key, "stretch").orderBy("start_time").rowsBetween(Window.unboundedPreceding, 0)
    met = F.coalesce(F.max("any_trough").over(before), F.lit(False))
    breaks = (F.col("gap") > gap_hours) & ~F.col("first_trough") & ~met
    soft = hard.withColumn("breaks", F.when(breaks, 1).otherwise(0)).withColumn(
        "episode", F.sum("breaks").over(within)
    )
    return (
        soft.groupBy(key, "stretch", "episode")
        .agg(
            F.min("start_time").alias("start_time"),
            F.max("end_time").alias("end_time"),
            F.bool_or("any_trough").alias("is_trough"),
            F.min_by("ref", "start_time").alias("ref"),
            F.sum("parts").alias("parts"),
        )
        .drop("stretch", "episode")
        .withColumn("hours", _hours(F.col("start_time"), F.col("end_time")))
    )


def _hours(start, end):
    return seconds_between(start, end) / 3600


def covered_days(intervals: DataFrame, keys: list[str], first_day: str, last_day: str) -> DataFrame:
    """Distinct days from ``first_day`` to ``last_day`` of the intervals."""
    days = F.when(F.col(last_day) >= F.col(first_day), F.sequence(F.col(first_day), F.col(last_day)))
    return intervals.select(*keys, F.explode(days).alias("day")).distinct()


#: Blocks of 1, 2, 4 ... days; the largest spans over 40,000 years.
LEVELS = 24


def aligned_blocks(first: Column, last: Column) -> Column:
    """The fewest aligned blocks of days that make up an interval, as (level, block).

    A block of a level holds ``2 ** level`` days. An interval has at most two of a
    level, so its length does not matter.
    """
    blocks = []
    for level in range(LEVELS):
        # First block that starts in the interval, and the block that its end lies in.
        low = -F.shiftright(-first.cast("long"), level)
        high = F.shiftright(last.cast("long") + 1, level)
        odd = lambda c: c.bitwiseAND(F.lit(1).cast("long")) == 1
        left = odd(low) & (low < high)
        after = F.when(left, low + 1).otherwise(low)
        blocks += [
            F.when(left, F.struct(F.lit(level).alias("level"), low.alias("block"))),
            F.when(odd(high) & (after < high), F.struct(F.lit(level).alias("level"), (high - 1).alias("block"))),
        ]
    return F.array_compact(F.array(*blocks))


def holding_blocks(day: Column) -> Column:
    """The block of every level that holds a day."""
    return F.array(*(F.shiftright(day.cast("long"), k) for k in range(LEVELS)))


def interval_blocks(intervals: DataFrame, keys: list[str], first_day: str, last_day: str) -> DataFrame:
    """Different blocks (keys, level, block) that make up the intervals of each key."""
    return intervals.select(*keys, F.explode(aligned_blocks(F.col(first_day), F.col(last_day))).alias("b")).select(
        *keys, F.col("b.level").alias("level"), F.col("b.block").alias("block")).distinct()


def days_in_intervals(days: DataFrame, intervals: DataFrame, keys: list[str], first_day: str, last_day: str) -> DataFrame:
    """Rows of ``days`` whose day lies in an interval of the same key.

    No day of an interval is listed: intervals become aligned blocks, equal blocks
    count once, and a day looks for the block that holds it on every level.
    """
    blocks = interval_blocks(intervals, keys, first_day, last_day)
    looked = days.select(*keys, "day").distinct().select(*keys, "day", F.posexplode(holding_blocks(F.col("day"))).alias("level", "block"))
    inside = looked.join(blocks, [*keys, "level", "block"], "left_semi").select(*keys, "day").distinct()
    return days.join(inside, [*keys, "day"], "left_semi")
