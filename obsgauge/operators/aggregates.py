"""Windowed aggregates that aggregate rules are judged on.

Distinct counts are exact by default.  Spark plans them as two shuffles, first
by (key, value) and then by key, with partial aggregation before both, so one
service that sends most of the data does not end up in one task.  Pass
``rsd`` for the sketch variant, which needs one shuffle of small buffers.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.attributes import bucket_signature

# Resource attributes whose spread per service is watched.
IDENTITY_ATTRIBUTES = ("service.version", "deployment.environment.name", "telemetry.sdk.language")


def window_start(ts: Column, window: str) -> Column:
    return F.window(ts, window)["start"]


def _distinct(df: DataFrame, keys: list[str], value: str, rsd: float | None, name: str = "cardinality") -> DataFrame:
    count = F.approx_count_distinct(value, rsd) if rsd else F.countDistinct(value)
    return df.groupBy(*keys).agg(count.alias(name))


def _windowed(df: DataFrame, window: str | None) -> tuple[DataFrame, list[str]]:
    if window is None:
        return df, []
    return df.withColumn("window_start", window_start(F.col("ts"), window)), ["window_start"]


def histogram_bucket_signatures(points: DataFrame, window: str | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct bucket layouts per (service, metric)."""
    df, extra = _windowed(points.where(F.col("type") == "histogram"), window)
    df = df.select(*extra, "service", F.col("name").alias("metric"),
                   bucket_signature(F.col("bucket_bounds")).alias("layout"))
    return _distinct(df, ["service", "metric", *extra], "layout", rsd)


def metric_attribute_values(points: DataFrame, window: str | None = None) -> DataFrame:
    """(service, metric, attribute, value), one row per attribute of a point."""
    df, extra = _windowed(points, window)
    return (df.select(*extra, "service", F.col("name").alias("metric"), F.explode("attrs").alias("attribute", "value"))
            .where(F.col("value").isNotNull()))


def metric_attribute_cardinality(points: DataFrame, window: str | None = None, rsd: float | None = None) -> DataFrame:
    """Distinct values per (service, metric, attribute key)."""
    keys = ["service", "metric", "attribute"] + (["window_start"] if window else [])
    return _distinct(metric_attribute_values(points, window), keys, "value", rsd)


def span_name_cardinality(spans: DataFrame, window: str | None = None, rsd: float | None = None) -> DataFrame:
    df, extra = _windowed(spans, window)
    return _distinct(df.select(*extra, "service", "name"), ["service", *extra], "name", rsd)


def resource_attribute_values(signals: Mapping[str, DataFrame], window: str | None = None,
                              attributes: tuple[str, ...] = IDENTITY_ATTRIBUTES) -> DataFrame:
    """(service, attribute, value) of the watched resource attributes over all signals."""
    out = None
    for df in signals.values():
        df, extra = _windowed(df, window)
        pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col("resource")[a].alias("value"))
                          for a in attributes])
        part = df.select("service", *extra, F.inline(pairs)).where(F.col("value").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def resource_attr_cardinality(signals: Mapping[str, DataFrame], window: str | None = None,
                              rsd: float | None = None) -> DataFrame:
    """Distinct values per (service, watched resource attribute)."""
    keys = ["service", "attribute"] + (["window_start"] if window else [])
    return _distinct(resource_attribute_values(signals, window), keys, "value", rsd)


def exemplar_coverage(points: DataFrame, window: str | None = None) -> DataFrame:
    """Histogram points, and those with an exemplar, per service."""
    df, extra = _windowed(points.where(F.col("type") == "histogram"), window)
    return df.groupBy("service", *extra).agg(
        F.count(F.lit(1)).alias("histogram_points"),
        F.count_if(F.coalesce(F.col("exemplar_count"), F.lit(0)) > 0).alias("with_exemplars"))


def _live_windows(df: DataFrame, window_s: int) -> DataFrame:
    """Each row once for its own window and once for the following one."""
    following = F.timestamp_micros(F.unix_micros("window_start") + F.lit(window_s * 1_000_000))
    return df.withColumn("window_start", F.explode(F.array(F.col("window_start"), following)))


def two_generation_max(per_window: DataFrame, keys: list[str], window_s: int = 3600,
                       value: str = "cardinality") -> DataFrame:
    """Value reported in a window: the larger of its own and the previous window's.

    A key stays visible for one silent window and is gone in the second.  Two
    copies per row and a max need no ordering, so no key is gathered.
    """
    return (_live_windows(per_window.select(*keys, "window_start", value), window_s)
            .groupBy(*keys, "window_start").agg(F.max(value).alias(value)))


def tracked_pairs(per_window: DataFrame, keys: list[str], window_s: int = 3600) -> DataFrame:
    """Number of live keys per window, over the window and the one before."""
    live = _live_windows(per_window.select(*keys, "window_start").distinct(), window_s)
    return (live.distinct().groupBy("window_start").agg(F.count(F.lit(1)).alias("pairs")))


def cardinality_sketches(values: DataFrame, keys: list[str], value: str = "value", lg_k: int = 14) -> DataFrame:
    """One mergeable distinct-count sketch per key (2**lg_k registers, fixed size)."""
    return values.groupBy(*keys).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer keys combined into estimates for coarser ones."""
    return (sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
            .select(*keys, F.hll_sketch_estimate("sketch").alias("estimate")))


def two_generations(sketches: DataFrame, keys: list[str], window_s: int = 3600) -> DataFrame:
    """Per window the larger of its own and the previous window's estimate, and the distinct values of both together.

    Takes the rows of ``stream_cardinality_sketches``.  A key is visible for one silent window and gone in the second.
    """
    live = _live_windows(sketches.select(*keys, "window_start", "sketch", "cardinality"), window_s)
    return live.groupBy(*keys, "window_start").agg(F.max("cardinality").alias("cardinality"), F.hll_union_agg("sketch").alias("sketch")).select(
        *keys, "window_start", "cardinality", F.hll_sketch_estimate("sketch").alias("together"))


def long_form(name: str, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Uniform view of a typed aggregate: (service, aggregate, dims, fields)."""
    dims = [c for c in rows.columns if c not in ("service", *fields)]

    def as_map(names: list[str], kind: str) -> Column:
        if not names:
            return F.create_map().cast(f"map<string,{kind}>")
        flat = [x for n in names for x in (F.lit(n), F.col(n).cast(kind))]
        return F.create_map(*flat)

    return rows.select("service", F.lit(name).alias("aggregate"),
                       as_map(dims, "string").alias("dims"), as_map(fields, "double").alias("fields"))


#: Numeric fields of each built-in aggregate.
AGGREGATE_FIELDS = {
    "metric_attribute_cardinality": ["cardinality"],
    "histogram_bucket_signatures": ["cardinality"],
    "span_name_cardinality": ["cardinality"],
    "resource_attr_cardinality": ["cardinality"],
    "exemplar_coverage": ["histogram_points", "with_exemplars"],
    "trace_health": ["traces", "orphan_ratio", "missing_root_ratio"],
}
