"""Evaluation grid, presence segments, counter increases and windowed ratios."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsgauge.functions.runs import consecutive_runs
from obsgauge.functions.timebins import micros


@dataclass(frozen=True)
class Grid:
    """Evaluation points start, start + step, ... up to and including end (UTC)."""

    start: datetime
    end: datetime
    step_s: int

    def __post_init__(self) -> None:
        if self.step_s <= 0:
            raise ValueError("step must be positive")
        if self.end <= self.start:
            raise ValueError("end must be after start")

    @staticmethod
    def _us(at: datetime) -> int:
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return round(at.timestamp() * 1_000_000)

    @property
    def start_us(self) -> int:
        return self._us(self.start)

    @property
    def step_us(self) -> int:
        return self.step_s * 1_000_000

    @property
    def points(self) -> int:
        return (self._us(self.end) - self.start_us) // self.step_us + 1

    @property
    def window_s(self) -> float:
        return (self._us(self.end) - self.start_us) / 1e6

    def position(self, ts: Column) -> Column:
        """First grid point at or after ``ts``."""
        return F.ceil(
            (micros(ts) - F.lit(self.start_us)) / F.lit(self.step_us)).cast("bigint")

    def time(self, position: Column) -> Column:
        return F.timestamp_micros(F.lit(self.start_us) + position * F.lit(self.step_us))

    def steps(self, seconds: float) -> int:
        """Steps until at least ``seconds`` have passed."""
        return math.ceil(seconds / self.step_s)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.points).withColumnRenamed("id", "position")


# --- presence ---------------------------------------------------------------------------------

def presence_points(samples: DataFrame, grid: Grid, lookback_s: int | None = None) -> DataFrame:
    """Distinct grid points t with a sample in (t - lookback, t]."""
    lookback_us = (lookback_s or grid.step_s) * 1_000_000
    offset = micros(F.col("ts")) - F.lit(grid.start_us)
    first = F.greatest(F.ceil(offset / F.lit(grid.step_us)).cast("bigint"), F.lit(0).cast("bigint"))
    # Last t with t < ts + lookback.
    last = F.least(F.ceil((offset + F.lit(lookback_us)) / F.lit(grid.step_us)).cast("bigint") - 1,
                   F.lit(grid.points - 1).cast("bigint"))
    near = F.col("ts").between(F.timestamp_micros(F.lit(grid.start_us - lookback_us)),
                               F.timestamp_micros(F.lit(grid.start_us + grid.step_us * (grid.points - 1))))
    df = samples.where(near).select(first.alias("_a"), last.alias("_b")).where(F.col("_a") <= F.col("_b"))
    if lookback_us <= grid.step_us:  # at most one point per sample
        return df.select(F.col("_a").alias("position")).distinct()
    # Few distinct ranges are left before they are spelled out.
    return df.distinct().select(F.explode(F.sequence("_a", "_b")).alias("position")).distinct()


def presence_grid(samples: DataFrame, grid: Grid, lookback_s: int | None = None) -> DataFrame:
    """Every grid point and whether there is data at it."""
    seen = presence_points(samples, grid, lookback_s).withColumn("_seen", F.lit(True))
    return (grid.frame(samples.sparkSession).join(seen, "position", "left")
            .select("position", grid.time(F.col("position")).alias("ts"),
                    F.coalesce("_seen", F.lit(False)).alias("has_data")))


def presence_segments(samples: DataFrame, grid: Grid, lookback_s: int | None = None) -> DataFrame:
    """Maximal runs of points with data; a lone point is a segment of length 0."""
    points = presence_points(samples, grid, lookback_s).withColumn("_all", F.lit(0))
    return (consecutive_runs(points, ["_all"], "position")
            .select("first_pos", "last_pos", grid.time(F.col("first_pos")).alias("start_ts"),
                    grid.time(F.col("last_pos")).alias("end_ts")))


def coverage(segments: DataFrame, grid: Grid) -> DataFrame:
    """Covered seconds, their share of the window, and whether the window is only partly covered."""
    covered = F.coalesce(F.sum((micros(F.col("end_ts")) - micros(F.col("start_ts"))) / F.lit(1e6)), F.lit(0.0))
    return segments.agg(covered.alias("covered_s"), F.count(F.lit(1)).alias("segments")).select(
        "segments", "covered_s", (F.col("covered_s") / F.lit(grid.window_s)).alias("share"),
        (F.col("covered_s") < F.lit(grid.window_s)).alias("partial"))


def usable_start(samples: DataFrame, grid: Grid) -> DataFrame:
    """Earliest grid point with data, and whether there is data at the end of the range."""
    seen = presence_points(samples, grid)
    return seen.agg(
        grid.time(F.min("position")).alias("usable_from"),
        F.coalesce(F.max("position") == F.lit(grid.points - 1), F.lit(False)).alias("data_at_end"))


# --- counters ---------------------------------------------------------------------------------

def _rise(value: Column, before: Column) -> Column:
    """Increase between two readings; after a reset the counter restarts from 0."""
    return F.when(value < before, value).otherwise(value - before)


def counter_increases(samples: DataFrame, grid: Grid, keys: Sequence[str], counters: Sequence[str],
                      history_s: int = 0) -> DataFrame:
    """Increase of cumulative counters per (series, grid step).

    Readings are compared inside their step first, so a long series is spread
    over many groups; what is ordered per series is one row per step.  The
    first reading of a series adds nothing.  No edge extrapolation is done.
    """
    keys, counters = list(keys), list(counters)
    begin = grid.start_us - history_s * 1_000_000 - grid.step_us
    finish = grid.start_us + grid.step_us * (grid.points - 1)
    df = (samples.where((F.col("ts") > F.timestamp_micros(F.lit(begin))) &
                        (F.col("ts") <= F.timestamp_micros(F.lit(finish))))
          .select(*keys, "ts", *counters, grid.position(F.col("ts")).alias("position")))
    in_step = Window.partitionBy(*keys, "position").orderBy("ts")
    df = df.select(*keys, "ts", "position", *counters,
                   *[_rise(F.col(c), F.lag(c).over(in_step)).alias(f"_d_{c}") for c in counters])
    per_step = df.groupBy(*keys, "position").agg(*[agg for c in counters for agg in (
        F.sum(f"_d_{c}").alias(f"_d_{c}"), F.min_by(c, "ts").alias(f"_f_{c}"), F.max_by(c, "ts").alias(f"_l_{c}"))])
    per_series = Window.partitionBy(*keys).orderBy("position")
    zero = F.lit(0)
    return per_step.select(*keys, "position", *[
        (F.coalesce(f"_d_{c}", zero)
         + F.coalesce(_rise(F.col(f"_f_{c}"), F.lag(f"_l_{c}").over(per_series)), zero)).alias(c)
        for c in counters])


def windowed_changes(increases: DataFrame, grid: Grid, keys: Sequence[str], counters: Sequence[str],
                     windows_s: Sequence[int]) -> DataFrame:
    """Increase over trailing windows, one row per stretch ``position`` to ``until`` (exclusive) over which no sum changes.

    A difference array: an increase at p enters every window at p and leaves a window of w steps at p + w, and one
    running sum per series serves all windows.  Rows grow with the readings, not with the length of a window.
    Stretches whose longest window holds no reading are left out.  Sums of whole numbers are exact; sums of
    fractions carry the rounding of what came and went, and are 0 where the counter did not rise in the window.
    """
    steps = {w: grid.steps(w) for w in windows_s}
    longest = max(steps.values())
    pairs = [(c, w) for w in steps for c in counters]

    def change(after: int | None) -> Column:
        """What changes ``after`` steps behind a reading; None: at the reading itself."""
        def part(value: Column, length: int) -> Column:
            zero = value * 0
            return value if after is None else -value if after == length else zero
        one = F.lit(1)
        return F.struct(
            (F.col("position") + F.lit(after or 0)).alias("_p"), part(one, longest).alias("_held"),
            *[part(F.when(F.col(c) > 0, 1).otherwise(0), steps[w]).alias(f"_risen_{c}_{w}") for c, w in pairs],
            *[part(F.col(c), steps[w]).alias(f"{c}_{w}") for c, w in pairs])

    changes = increases.select(*keys, F.inline(F.array(change(None), *[change(n) for n in sorted(set(steps.values()))])))
    series = Window.partitionBy(*keys).orderBy("_p")
    upto = series.rangeBetween(Window.unboundedPreceding, Window.currentRow)  # changes at one step count together
    sums = changes.select(
        *keys, F.greatest("_p", F.lit(0)).alias("position"),
        F.least(F.lead("_p").over(series), F.lit(grid.points)).cast("bigint").alias("until"),
        *[F.sum(c).over(upto).alias(c) for c in changes.columns[len(keys) + 1:]])
    return sums.where((F.col("_held") > 0) & (F.col("until") > F.col("position"))).select(
        *keys, "position", "until",
        *[F.when(F.col(f"_risen_{c}_{w}") > 0, F.col(f"{c}_{w}")).otherwise(F.lit(0)).alias(f"{c}_{w}") for c, w in pairs])


def at_every_step(stretches: DataFrame) -> DataFrame:
    """One row per step of each stretch ``position`` to ``until``."""
    rest = [c for c in stretches.columns if c not in ("position", "until")]
    return stretches.select(F.explode(F.sequence("position", F.col("until") - 1)).alias("position"), *rest)


def ratio_changes(samples: DataFrame, grid: Grid, keys: Sequence[str], errors: str, total: str,
                  windows_s: Sequence[int]) -> DataFrame:
    """Share of errors over trailing windows, one row per stretch of steps with the same ratios."""
    inc = counter_increases(samples, grid, keys, [errors, total], history_s=max(windows_s))
    sums = windowed_changes(inc, grid, keys, [errors, total], windows_s)
    return sums.select(*keys, "position", "until", *[
        F.when(F.col(f"{total}_{w}") > 0, F.col(f"{errors}_{w}") / F.col(f"{total}_{w}")).alias(f"ratio_{w}")
        for w in windows_s])


def windowed_ratio(samples: DataFrame, grid: Grid, keys: Sequence[str], errors: str, total: str,
                   windows_s: Sequence[int]) -> DataFrame:
    """Share of errors over trailing windows at every step: one ``ratio_<seconds>`` column per window.

    A ratio is NULL while its window holds no events.
    """
    ratios = at_every_step(ratio_changes(samples, grid, keys, errors, total, windows_s))
    return ratios.select(*keys, "position", grid.time(F.col("position")).alias("ts"), *[f"ratio_{w}" for w in windows_s])


# --- derived series ---------------------------------------------------------------------------

RECORDED = "recorded"
INLINED = "inlined"
PLAIN = "plain"


def classify_series(name: str, defined: Mapping[str, object]) -> str:
    """A defined name can be inlined; a level:name form without definition must be stored."""
    if name in defined:
        return INLINED
    return RECORDED if ":" in name else PLAIN


def derived_series(name: str, samples: DataFrame, defined: Mapping[str, Callable[[DataFrame], DataFrame]],
                   stored: Mapping[str, DataFrame] | None = None, prefer_stored: bool = False) -> DataFrame:
    """A recorded series by name, from its definition over raw samples or from a stored table.

    A recorded name that is neither defined nor stored is refused: replaying
    against nothing would look like silence.
    """
    stored = stored or {}
    if name in stored and (prefer_stored or name not in defined):
        return stored[name]
    kind = classify_series(name, defined)
    if kind == INLINED:
        return defined[name](samples)
    if kind == RECORDED:
        raise LookupError(f"series {name} is neither defined nor stored")
    return samples.where(F.col("metric") == name)
