"""Time grids and interval joins expressed as equi-joins on dyadic time spans.

A plain range condition makes Spark compare every pair.  Time is divided into spans of one minute, two, four and so
on.  An interval is noted at the level of its own length, where it touches two spans at most, so seconds and years
cost the same; a point looks up the span that holds it at each of the ``LEVELS``.  What is left is a hash join on (level, span) with the exact
condition as a residual, which shuffles, spills and splits under skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def plus_seconds(ts: Column, seconds: Column | float | int) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return F.timestamp_micros((micros(ts) + secs * F.lit(1e6)).cast("bigint"))


def bin_of(ts: Column, width_s: int) -> Column:
    return F.floor(micros(ts) / F.lit(width_s * 1_000_000)).cast("bigint")


#: Spans of 1 minute to 2 ** 30 minutes (2,000 years).
LEVELS = 31
UNIT_S = 60


def _unit(ts: Column) -> Column:
    return bin_of(ts, UNIT_S)


def own_level(start: Column, end: Column) -> Column:
    """The level at which an interval touches two spans at most."""
    n = _unit(end) - _unit(start)
    return F.least(F.when(n > 0, F.floor(F.log2(n.cast("double"))) + 1).otherwise(0), F.lit(LEVELS - 1)).cast("int")


def _spans(start: Column, end: Column, level: Column) -> Column:
    """(level, span) of the spans that an interval touches at a level not under its own."""
    first, last = _unit(start), _unit(end)
    return F.transform(F.array_distinct(F.array(F.call_function("shiftright", first, level), F.call_function("shiftright", last, level))),
                       lambda n: F.struct(level.alias("_ilevel"), n.alias("_ispan")))


def points_in_intervals(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, how: str = "inner") -> DataFrame:
    """Join points to the closed intervals [start, end] that hold them.

    Every (point, interval) pair is met exactly once, at the level of the interval; equal instants
    are looked up once.  The two frames must not share column names.
    """
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    instants = points.select(F.col(at).alias("_at")).where(F.col(at).isNotNull()).distinct().select("_at", F.explode(levels).alias("_level"))
    instants = instants.withColumn("_span", F.call_function("shiftright", _unit(F.col("_at")), F.col("_level")))
    noted = intervals.where(F.col(start) <= F.col(end)).select("*", F.inline(_spans(F.col(start), F.col(end), own_level(F.col(start), F.col(end)))))
    cond = (F.col("_level") == F.col("_ilevel")) & (F.col("_span") == F.col("_ispan")) & F.col("_at").between(F.col(start), F.col(end))
    if how == "left_anti":
        held = instants.join(noted, cond, "left_semi").select("_at").distinct()
        return points.join(held, F.col(at) == F.col("_at"), how)
    pairs = instants.join(noted, cond).drop("_level", "_span", "_ilevel", "_ispan")
    return points.join(pairs, F.col(at) == F.col("_at"), how).drop("_at")


def overlapping(left: DataFrame, l_start: str, l_end: str, right: DataFrame, r_start: str, r_end: str, key: str) -> DataFrame:
    """``key`` values of left intervals that share more than a border with a right one.

    Two intervals meet at the level of the longer one; each is noted at its own level and all above.
    """

    def noted(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
        own = own_level(F.col(start), F.col(end))
        up = F.flatten(F.transform(F.sequence(own, F.lit(LEVELS - 1)), lambda level: _spans(F.col(start), F.col(end), level)))
        return df.where(F.col(start) <= F.col(end)).select("*", own.alias(f"_{side}own"), F.inline(up)).withColumnsRenamed({"_ilevel": f"_{side}level", "_ispan": f"_{side}span"})

    a = noted(left.select(key, l_start, l_end), l_start, l_end, "l")
    b = noted(right.select(F.col(r_start).alias("_rs"), F.col(r_end).alias("_re")), "_rs", "_re", "r")
    cond = ((F.col("_llevel") == F.col("_rlevel")) & (F.col("_lspan") == F.col("_rspan")) & (F.col("_llevel") == F.greatest("_lown", "_rown"))
            & (F.col(l_start) < F.col("_re")) & (F.col(l_end) > F.col("_rs")))
    return a.join(b, cond, "left_semi").select(key).distinct()


def grid_index(ts: Column, origin: Column, step_s: int) -> Column:
    """Number of the first grid point at or after ``ts``."""
    return F.ceil((micros(ts) - micros(origin)) / F.lit(step_s * 1_000_000)).cast("bigint")
