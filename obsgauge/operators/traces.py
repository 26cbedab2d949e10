"""Trace completeness and the service graph edges, from one parent look-up.

The look-up meets on (trace, span): its keys are near unique, so a trace
that holds a third of all spans still spreads over all tasks.  References are
made distinct per (trace, parent, service) before they meet, with map-side
combine, so a parent with very many children arrives as a few rows.  Whether a
parent exists takes one scan: each span notes its own id and the one it refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _earliest(spans: DataFrame) -> Column:
    return F.min("ts") if "ts" in spans.columns else F.min(F.lit(None).cast("timestamp"))


def parent_links(spans: DataFrame) -> DataFrame:
    """Distinct (trace, parent reference, service) with the earliest span time behind each, and whether the trace holds the parent."""
    own = F.struct(F.col("span_id").alias("_id"), F.lit(True).alias("_own"))
    parent = F.struct(F.col("parent_span_id").alias("_id"), F.lit(False).alias("_own"))
    user = F.when(~F.col("_own"), F.col("service")).alias("service")
    ids = (spans.select("*", F.inline(F.array(own, parent)))
           .groupBy("trace_id", "_id", "_own", user).agg(_earliest(spans).alias("ts")))
    # An id has one row of its own and one per service that refers to it.
    held = F.max("_own").over(Window.partitionBy("trace_id", "_id"))
    found = held & F.col("trace_id").isNotNull() & F.col("_id").isNotNull()
    return ids.select("trace_id", F.col("_id").alias("parent_span_id"), "service", "ts", "_own", found.alias("found")).where(~F.col("_own")).drop("_own")


def caller_links(spans: DataFrame) -> DataFrame:
    """Resolved references with the service of the parent span.

    A span id seen twice belongs to its earliest sighting, then to the
    smallest service.
    """
    first = F.min(F.struct("ts", "service") if "ts" in spans.columns else F.struct("service"))["service"]
    owners = spans.groupBy(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s")).agg(first.alias("caller"))
    refs = (spans.where(F.col("parent_span_id").isNotNull())
            .groupBy("trace_id", "parent_span_id", "service").agg(_earliest(spans).alias("ts")))
    hit = (F.col("trace_id") == F.col("_t")) & (F.col("parent_span_id") == F.col("_s"))
    return refs.join(owners, hit).drop("_t", "_s")


def trace_participation(links: DataFrame) -> DataFrame:
    """Per (trace, service): does it hold a dangling reference, is the trace rootless, is any reference dangling?"""
    dangling = F.col("parent_span_id").isNotNull() & ~F.col("found")
    per_service = links.groupBy("trace_id", "service").agg(
        F.max(F.col("parent_span_id").isNull()).alias("_root"),
        F.max(dangling).alias("dangling"),
        F.min("ts").alias("ts"))
    # At this point a trace has at most one row per service of the fleet.
    trace = Window.partitionBy("trace_id")
    return per_service.select(
        "trace_id", "service", "dangling",
        (~F.max("_root").over(trace)).alias("rootless"),
        F.max("dangling").over(trace).alias("broken"),
        F.min("ts").over(trace).alias("trace_ts"))


def trace_health(spans: DataFrame, window: str | None = None, closed_before=None) -> DataFrame:
    """Traces a service took part in, and the shares that are orphaned or rootless.

    A rootless trace counts against the services with a dangling reference, or
    against every participant if there is none.  With ``window`` a trace falls
    in the window of its earliest span; ``closed_before`` keeps finished
    windows only.
    """
    part = trace_participation(parent_links(spans))
    keys = ["service"]
    if window is not None:
        part = part.withColumn("_w", F.window("trace_ts", window))
        if closed_before is not None:
            part = part.where(F.col("_w.end") <= F.lit(closed_before))
        part = part.withColumn("window_start", F.col("_w.start"))
        keys.append("window_start")
    blamed = F.col("rootless") & (F.col("dangling") | ~F.col("broken"))
    traces = F.count(F.lit(1))
    return part.groupBy(*keys).agg(
        traces.alias("traces"),
        (F.count_if(F.col("dangling")) / traces).alias("orphan_ratio"),
        (F.count_if(blamed) / traces).alias("missing_root_ratio"))


def service_dependency(spans: DataFrame) -> DataFrame:
    """Caller → callee edges, counted in traces; self calls and unresolved parents left out."""
    return (caller_links(spans).where(F.col("caller") != F.col("service"))
            .select("trace_id", "caller", F.col("service").alias("callee")).distinct()
            .groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("traces")))
