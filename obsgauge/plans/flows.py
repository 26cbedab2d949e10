"""End-to-end flows: telemetry to scores, usage to showback, history to scorecards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgauge.operators import aggregates as agg
from obsgauge.operators import judge, replay, scoring, series, spend
from obsgauge.operators.rules import aggregate_rollup, item_rollup, rule_results
from obsgauge.operators.traces import service_dependency, trace_health
from obsgauge.plans.catalogue import DEFAULT_RULES, Rule, catalogue_frame, check_criteria
from obsgauge.sources import snapshots
from obsgauge.sources.shared import written

#: name → function of the signal tables; register further aggregates here.
AGGREGATES: dict[str, Callable[[Mapping[str, DataFrame]], DataFrame]] = {
    "metric_attribute_cardinality": lambda s: agg.metric_attribute_cardinality(s["metric"]),
    "histogram_bucket_signatures": lambda s: agg.histogram_bucket_signatures(s["metric"]),
    "span_name_cardinality": lambda s: agg.span_name_cardinality(s["span"]),
    "resource_attr_cardinality": lambda s: agg.resource_attr_cardinality(s),
    "exemplar_coverage": lambda s: agg.exemplar_coverage(s["metric"]),
    "trace_health": lambda s: trace_health(s["span"]),
}


def register_aggregate(name: str, build: Callable[[Mapping[str, DataFrame]], DataFrame]) -> None:
    """Make a new aggregate known; rules refer to it by name."""
    if name in AGGREGATES:
        raise ValueError(f"aggregate {name} is already registered")
    AGGREGATES[name] = build


@dataclass
class Scoring:
    """Lazy frames of one scoring of the given signals; nothing runs until a frame is used."""

    spark: SparkSession
    signals: Mapping[str, DataFrame]
    rules: Sequence[Rule] = DEFAULT_RULES
    verified: DataFrame | None = None

    @cached_property
    def catalogue(self) -> DataFrame:
        return catalogue_frame(self.spark, self.rules)

    @cached_property
    def aggregates(self) -> dict[str, DataFrame]:
        names = {r.aggregate for r in self.rules if r.aggregate}
        unknown = names - set(AGGREGATES)
        if unknown:
            raise LookupError(f"unknown aggregates: {sorted(unknown)}")
        return {n: AGGREGATES[n](self.signals) for n in sorted(names)}

    def check(self) -> None:
        """Resolve every criteria against its input; runs no job."""
        for r in self.rules:
            if r.aggregate:
                check_criteria(r, self.aggregates[r.aggregate])
            else:
                for signal, df in self.signals.items():
                    if r.applies_to(signal):
                        check_criteria(r, df)

    @cached_property
    def rollup(self) -> DataFrame:
        parts = []
        if any(r.aggregate is None for r in self.rules):
            parts.append(item_rollup(self.signals, self.rules))
        if any(r.aggregate for r in self.rules):
            parts.append(aggregate_rollup(self.aggregates, self.rules))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @cached_property
    def sampled_results(self) -> DataFrame:
        return rule_results(self.rollup, self.catalogue)

    @cached_property
    def results(self) -> DataFrame:
        if self.verified is None:
            return self.sampled_results
        return scoring.apply_verified(self.sampled_results, self.verified, self.catalogue)

    def write_results(self) -> Scoring:
        """Runs the scoring and keeps its results (a row per service and rule) as a table: frames and snapshots made of them read that."""
        self.results = written(self.results, "rule-results")
        return self

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.service_scores(self.results)

    @cached_property
    def findings(self) -> DataFrame:
        return scoring.findings(self.results, self.catalogue)

    @cached_property
    def edges(self) -> DataFrame:
        return service_dependency(self.signals["span"])


def long_aggregates(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Typed aggregates in the common long form used by calibration."""
    parts = [agg.long_form(n, df, agg.AGGREGATE_FIELDS[n]) for n, df in frames.items() if n in agg.AGGREGATE_FIELDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Showback:
    lines: DataFrame
    storage: DataFrame
    total: DataFrame
    lifecycle: DataFrame
    trend: DataFrame | None
    total_delta: DataFrame | None


def showback(spark: SparkSession, usage: DataFrame, stored: DataFrame, rates: spend.Rates, window_s: float,
             taken_at, history_path: str | None = None) -> Showback:
    """Price usage and storage, compare with the last stored report, then append this one."""
    lines = spend.price_lines(usage, rates, window_s)
    storage = spend.price_storage(stored, rates)
    total = spend.total_monthly(lines, storage)
    trend = delta = None
    if history_path is not None:
        last = snapshots.read_last_snapshot(spark, history_path, taken_at)
        if last is not None:
            trend = spend.cost_trend(lines, last.where(F.col("part") == "line"))
            delta = spend.trend_total(total, last.agg(F.sum("total_monthly").alias("total_monthly")))
        snapshots.write_cost_snapshot(history_path, spend.cost_report(spark, lines, storage, taken_at), taken_at)
    return Showback(lines, storage, total, spend.lifecycle_savings(stored, rates), trend, delta)


@dataclass
class Backtest:
    segments: DataFrame
    coverage: DataFrame
    firings: DataFrame
    scorecard: DataFrame
    caveats: DataFrame


def backtest_run(presence: DataFrame, samples: DataFrame, incidents: DataFrame,
                 alerts: Sequence[replay.AlertSpec], grid: series.Grid, keys: Sequence[str], errors: str,
                 total: str, grace_s: float = 0.0, firings_path: str | None = None) -> Backtest:
    """Presence → replay of every alert in every segment → scorecards, all alerts in one job.

    With ``firings_path`` the firings are written there once and every verdict
    reads them back; without it the verdicts share the replay within one job.
    """
    names = [a.name for a in alerts]
    if len(set(names)) != len(names):
        raise ValueError("alert names must be distinct")
    segments = series.presence_segments(presence, grid)
    coverage = series.coverage(segments, grid)
    firings = replay.replay_alerts(samples, segments, alerts, grid, keys, errors, total)
    if firings_path is not None:
        firings.write.mode("overwrite").parquet(firings_path)
        firings = presence.sparkSession.read.schema(firings.schema).parquet(firings_path)
    card = judge.scorecard(firings, incidents, segments, coverage, names, grace_s)
    partial = coverage.where(F.col("partial")).select(F.format_string(
        "%.0f of %.0f seconds were observed; nothing is said about the rest",
        F.col("covered_s"), F.lit(grid.window_s)).alias("caveat"))
    edges = coverage.select(F.lit(
        "increases are reset-aware and not extrapolated to window edges; results may differ by one step").alias("caveat"))
    return Backtest(segments, coverage, firings, card, partial.unionByName(edges).distinct())
