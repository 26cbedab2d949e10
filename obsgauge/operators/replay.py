"""Alert replay over history: structured alert specs, firings, burn rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.runs import consecutive_runs
from obsgauge.operators.series import Grid, at_every_step, ratio_changes

_COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class AlertSpec:
    """Error share over every listed window compared with a threshold, held for ``for_s``."""

    name: str
    windows_s: tuple[int, ...]
    threshold: float
    for_s: int = 0
    comparison: str = ">"
    severity: str = ""
    labels: Mapping[str, str] | None = None

    def __post_init__(self) -> None:
        if not self.name or not self.windows_s:
            raise ValueError("an alert needs a name and at least one window")
        if self.comparison not in _COMPARE:
            raise ValueError(f"{self.name}: unknown comparison {self.comparison!r}")
        if self.for_s < 0 or min(self.windows_s) <= 0:
            raise ValueError(f"{self.name}: negative duration")

    def condition(self) -> Column:
        """True while all windows meet the threshold; an empty window does not."""
        out = F.lit(True)
        for w in self.windows_s:
            out = out & _COMPARE[self.comparison](F.col(f"ratio_{w}"), F.lit(float(self.threshold)))
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class BurnWindow:
    short_s: int
    long_s: int
    factor: float
    for_s: int
    severity: str


# The default fast and slow pairs.
DEFAULT_BURN_WINDOWS = (
    BurnWindow(300, 3600, 14.4, 120, "page"),
    BurnWindow(1800, 21600, 6.0, 900, "ticket"),
)


def burn_rate_alerts(name: str, objective: float,
                     windows: Sequence[BurnWindow] = DEFAULT_BURN_WINDOWS) -> list[AlertSpec]:
    """One alert per window pair: both error shares above factor × error budget."""
    if not 0 < objective < 1:
        raise ValueError(f"{name}: objective {objective} must be between 0 and 1")
    return [AlertSpec(f"{name}-burnrate-{w.severity}-{w.short_s}s", (w.short_s, w.long_s),
                      w.factor * (1 - objective), w.for_s, severity=w.severity,
                      labels={"severity": w.severity, "slo_policy": name})
            for w in windows]


def true_steps(ratios: DataFrame, alerts: Sequence[AlertSpec], keys: Sequence[str], grid: Grid) -> DataFrame:
    """(rule, series, step) where an alert condition holds, all alerts in one pass.

    Ratios may come as stretches (``ratio_changes``): only those that meet a condition are spelled out.
    """
    hits = F.array_compact(F.array(*[
        F.when(a.condition(), F.struct(F.lit(a.name).alias("rule"),
                                       F.lit(grid.steps(a.for_s)).cast("bigint").alias("for_steps")))
        for a in alerts]))
    until = [c for c in ("until",) if c in ratios.columns]
    met = ratios.select(*keys, "position", *until, hits.alias("_hits")).where(F.size("_hits") > 0)
    return (at_every_step(met) if until else met).select(*keys, "position", F.inline("_hits"))


def replay(steps: DataFrame, segments: DataFrame, keys: Sequence[str], grid: Grid) -> DataFrame:
    """Firings per (rule, series): pending from the first true step, fired once it held for ``for``.

    State does not cross a segment border: a run that is still true on the
    last step of its segment has no resolution (NULL).
    """
    keys = list(keys)
    # Segments lie on the grid, so membership is an equi-join on the step.
    inside = segments.select(F.col("first_pos").alias("segment"), F.col("last_pos").alias("segment_last"),
                             F.explode(F.sequence("first_pos", "last_pos")).alias("position"))
    runs = consecutive_runs(steps.join(inside, "position"),
                            ["rule", "for_steps", *keys, "segment", "segment_last"], "position")
    fired = F.col("first_pos") + F.col("for_steps")
    resolved = F.when(F.col("last_pos") < F.col("segment_last"), F.col("last_pos") + 1)
    return (runs.where(fired <= F.col("last_pos"))
            .select("rule", *keys, grid.time(F.col("segment")).alias("segment_start"),
                    grid.time(F.col("first_pos")).alias("active_at"), grid.time(fired).alias("fired_at"),
                    grid.time(resolved).alias("resolved_at")))


def replay_alerts(samples: DataFrame, segments: DataFrame, alerts: Sequence[AlertSpec], grid: Grid,
                  keys: Sequence[str], errors: str, total: str) -> DataFrame:
    """Ratios, conditions and firings of all alerts in one job."""
    windows = sorted({w for a in alerts for w in a.windows_s})
    ratios = ratio_changes(samples, grid, keys, errors, total, windows)
    return replay(true_steps(ratios, alerts, keys, grid), segments, keys, grid)


def pages_by_rule(firings: DataFrame) -> DataFrame:
    return firings.groupBy("rule").agg(F.count(F.lit(1)).alias("firings"))


def alert_states(firings: DataFrame) -> DataFrame:
    """Replayed alerts with their state at the end of history."""
    return firings.withColumn("state", F.when(F.col("resolved_at").isNull(), "firing").otherwise("resolved"))


def alerts_in_state(alerts: DataFrame, state: str = "") -> DataFrame:
    """Alerts in one state; an empty state keeps all."""
    return alerts.where(F.col("state") == state) if state else alerts
