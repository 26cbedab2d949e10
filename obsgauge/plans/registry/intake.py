"""Registered queries through the OTLP intake: payload texts made of the tables, parsed and compared with their views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.plans.registry.base import query
from obsgauge.sources.otlp import otlp_from_messages
from obsgauge.sources.tables import Tables


def _kv(**values: Column) -> Column:
    """A list of string attributes; those without a value are not sent."""
    return F.filter(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k.replace("__", ".")).alias("key"), F.struct(v.alias("stringValue")).alias("value")))
                              for k, v in values.items()]), lambda e: e.isNotNull())


def _message(signal: str, resource: Column, items: Column) -> Column:
    """One payload text with one record, as a collector would send it."""
    outer, scopes, inner = {"span": ("resourceSpans", "scopeSpans", "spans"), "metric": ("resourceMetrics", "scopeMetrics", "metrics"),
                            "log": ("resourceLogs", "scopeLogs", "logRecords")}[signal]
    scope = F.struct(F.array(items).alias(inner))
    one = F.struct(F.struct(resource.alias("attributes")).alias("resource"), F.array(scope).alias(scopes))
    return F.to_json(F.struct(F.array(one).alias(outer))).alias("value")


def _resource(df: DataFrame) -> Column:
    return _kv(service__name=F.col("resource")["service.name"], deployment__environment__name=F.col("resource")["deployment.environment.name"])


@query("otlp_spans", """
select service, env, kind, status, count(*) as spans, count(distinct trace_id) as traces, count(parent_span_id) as children
from v_spans group by service, env, kind, status""")
def otlp_spans(t: Tables) -> DataFrame:
    s = t.spans()
    code = F.when(F.col("kind") == "internal", 1).when(F.col("kind") == "server", 2).otherwise(3)
    long_form = F.concat(F.lit("SPAN_KIND_"), F.upper("kind"))
    span = F.struct(
        F.lpad(F.col("trace_id").cast("string"), 32, "0").alias("traceId"), F.lpad(F.col("span_id").cast("string"), 16, "0").alias("spanId"),
        F.lpad(F.coalesce("parent_span_id", F.lit(0)).cast("string"), 16, "0").alias("parentSpanId"),  # all zeros: no parent
        F.when(F.col("span_id") % 2 == 0, code.cast("string")).otherwise(long_form).alias("kind"),
        F.struct(F.when(F.col("status") == "error", 2).otherwise(1).cast("string").alias("code")).alias("status"))
    got = otlp_from_messages(s.select(_message("span", _resource(s), span)), "span")
    return (got.groupBy("service", F.col("resource")["deployment.environment.name"].alias("env"), "kind", "status")
            .agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"), F.count("parent_span_id").alias("children")))


SHAPES = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")


@query("otlp_metrics", """
select service, name, unit, case event_id % 5 when 0 then 'gauge' when 1 then 'sum' when 2 then 'histogram'
         when 3 then 'exponential_histogram' else 'summary' end as type,
       count(*) as points, count(distinct attr_k) as label_values,
       sum(case when event_id % 5 = 4 then 0 else exemplar_count end)::bigint as exemplars,
       count(case when event_id % 5 = 2 then 1 end) as with_bounds
from v_metric_points group by service, name, unit, 4""")
def otlp_metrics(t: Tables) -> DataFrame:
    """Every point as one of the five shapes."""
    p = t.points()
    point = F.struct(_kv(k=F.col("attrs")["k"]).alias("attributes"),
                     F.when(F.col("exemplar_count") > 0, F.array(F.struct(F.lit("1").alias("timeUnixNano")))).alias("exemplars"),
                     F.array(F.lit(0.5), F.lit(1.0)).alias("explicitBounds"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("bucketCounts"))
    shapes = [F.when(F.col("event_id") % 5 == k, F.struct(F.array(point).alias("dataPoints"))).alias(name) for k, name in enumerate(SHAPES)]
    metric = F.struct("name", "unit", *shapes)
    got = otlp_from_messages(p.select(_message("metric", _resource(p), metric)), "metric")
    return (got.groupBy("service", "name", "unit", "type").agg(
        F.count(F.lit(1)).alias("points"), F.countDistinct(F.col("attrs")["k"]).alias("label_values"),
        F.sum("exemplar_count").cast("bigint").alias("exemplars"), F.count_if(F.size("bucket_bounds") == 2).alias("with_bounds")))


@query("otlp_logs", """
select service, severity_text, severity as severity_number, has_trace_id, count(*) as records, sum(body_len)::bigint as body_bytes
from v_logs group by service, severity_text, severity, has_trace_id""")
def otlp_logs(t: Tables) -> DataFrame:
    s = t.logs()
    record = F.struct(
        F.col("severity_text").alias("severityText"),
        F.when(F.col("severity_text") == "", F.col("severity_number")).otherwise(0).cast("string").alias("severityNumber"),
        F.struct(F.repeat(F.lit("x"), F.col("body_len")).alias("stringValue")).alias("body"),
        F.when(F.col("has_trace_id"), F.lit("0" * 30 + "a1")).otherwise(F.lit("0" * 32)).alias("traceId"))
    got = otlp_from_messages(s.select(_message("log", _resource(s), record)), "log")
    return got.groupBy("service", "severity_text", "severity_number", "has_trace_id").agg(
        F.count(F.lit(1)).alias("records"), F.sum("body_len").cast("bigint").alias("body_bytes"))


@query("otlp_long_values", """
select doc_id, coalesce(source, '<unknown>') as service, strlen(text)::bigint as bytes, md5(text) as digest, lang as last_value from documents""")
def otlp_long_values(t: Tables) -> DataFrame:
    """Texts of any length as an attribute, a repeated key (the last value counts) and the id in a resource attribute."""
    d = t.read("documents")
    twice = F.concat(_kv(lang=F.lit("first")), _kv(text=F.col("text")), _kv(lang=F.col("lang")))
    resource = _kv(service__name=F.col("source"), id=F.col("doc_id").cast("string"))
    got = otlp_from_messages(d.select(_message("log", resource, F.struct(twice.alias("attributes")))), "log")
    return got.select(F.col("resource")["id"].cast("bigint").alias("doc_id"), "service", F.octet_length(F.col("attrs")["text"]).alias("bytes"),
                      F.md5(F.col("attrs")["text"]).alias("digest"), F.col("attrs")["lang"].alias("last_value"))
