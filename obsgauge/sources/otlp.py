"""OTLP payloads (JSON) flattened into spans, metric points and log records.

The same functions serve batch files, file streams and message values: they
only see a DataFrame with the payload columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgauge import schemas
from obsgauge.functions.attributes import (
    normalize_severity,
    service_of,
    span_kind_name,
    status_name,
    stringify_double,
)

SCHEMAS = {"span": schemas.OTLP_TRACES, "metric": schemas.OTLP_METRICS, "log": schemas.OTLP_LOGS}


def value_text(value: Column) -> Column:
    """Text of a typed attribute value; composite values keep their JSON form."""
    return F.coalesce(
        value["stringValue"], value["intValue"], stringify_double(value["doubleValue"]),
        value["boolValue"].cast("string"), value["arrayValue"], value["kvlistValue"], value["bytesValue"], F.lit(""))


def attribute_map(attrs: Column) -> Column:
    """key/value list → map; a repeated key keeps its last value, a missing list is an empty map."""
    none = F.create_map().cast("map<string,string>")
    named = F.filter(attrs, lambda kv: kv["key"].isNotNull())
    keys = F.transform(named, lambda kv: kv["key"])
    once = F.array_distinct(keys)

    def entry(kv: Column) -> Column:
        return F.struct(kv["key"].alias("key"), value_text(kv["value"]).alias("value"))

    plain = F.map_from_entries(F.transform(named, entry))
    # Only lists with a repeated key take the slower way.
    repeated = F.map_from_entries(F.transform(once, lambda k: entry(
        F.element_at(F.filter(named, lambda kv: kv["key"] == k), -1))))
    return F.coalesce(F.when(F.size(once) == F.size(keys), plain).otherwise(repeated), none)


def _service(attrs: Column) -> Column:
    """Only a string ``service.name`` names a service."""
    named = F.filter(attrs, lambda kv: kv["key"] == "service.name")
    return service_of(F.try_element_at(named, F.lit(-1))["value"]["stringValue"])


def _time(nanos: Column) -> Column:
    return F.timestamp_micros((nanos.try_cast("bigint") / 1000).cast("bigint"))


def _id(text: Column) -> Column:
    """An absent, empty or all-zero id is no id."""
    return F.when(~text.rlike("^0*$"), text)


def _scopes(payload: DataFrame, resources: str, scopes: str, items: str) -> DataFrame:
    """One row per record, with its service, resource and scope.

    Only the last step drops what is empty: Spark would put the filter of an inner explode under the parsing, which then runs for it too.
    """
    per_resource = payload.select(F.explode_outer(resources).alias("r"))
    attrs = F.col("r.resource.attributes")
    return (per_resource.select(_service(attrs).alias("service"), attribute_map(attrs).alias("resource"),
                                F.explode_outer(F.col(f"r.{scopes}")).alias("s"))
            .select("service", "resource", F.col("s.scope").alias("scope"), F.explode(F.col(f"s.{items}")).alias("i")))


def spans_from(payload: DataFrame) -> DataFrame:
    i = F.col("i")
    return _scopes(payload, "resourceSpans", "scopeSpans", "spans").select(
        "service", "resource", "scope", F.coalesce(_id(i["traceId"]), F.lit("")).alias("trace_id"), _id(i["spanId"]).alias("span_id"),
        _id(i["parentSpanId"]).alias("parent_span_id"), F.coalesce(i["name"], F.lit("")).alias("name"),
        span_kind_name(i["kind"]).alias("kind"), status_name(i["status"]["code"]).alias("status"),
        attribute_map(i["attributes"]).alias("attrs"), _time(i["startTimeUnixNano"]).alias("ts"),
        _time(i["endTimeUnixNano"]).alias("end_ts"), _id(i["spanId"]).alias("item_id"))


def metric_points_from(payload: DataFrame) -> DataFrame:
    """One row per data point; a metric without a shape yields none.

    Only explicit histograms carry bounds and counts, and summaries have no
    exemplars.
    """
    i = F.col("i")
    shapes = {"gauge": "gauge", "sum": "sum", "histogram": "histogram",
              "exponentialHistogram": "exponential_histogram", "summary": "summary"}
    kind = F.coalesce(*[F.when(i[f].isNotNull(), F.lit(name)) for f, name in shapes.items()])
    points = F.coalesce(*[i[f]["dataPoints"] for f in shapes])
    p, histogram = F.col("p"), F.col("type") == "histogram"
    exemplars = F.when(F.col("type") == "summary", F.lit(0)).otherwise(
        F.greatest(F.coalesce(F.size(p["exemplars"]), F.lit(0)), F.lit(0)))
    return (_scopes(payload, "resourceMetrics", "scopeMetrics", "metrics")
            .select("service", "resource", "scope", F.coalesce(i["name"], F.lit("")).alias("name"),
                    F.coalesce(i["unit"], F.lit("")).alias("unit"), kind.alias("type"), F.explode(points).alias("p"))
            .select("service", "resource", "scope", "name", "type", "unit",
                    exemplars.alias("exemplar_count"),
                    F.when(histogram, F.coalesce(p["explicitBounds"], F.array().cast("array<double>")))
                    .alias("bucket_bounds"),
                    F.when(histogram, F.coalesce(p["bucketCounts"].cast("array<bigint>"),
                                                 F.array().cast("array<bigint>"))).alias("bucket_counts"),
                    attribute_map(p["attributes"]).alias("attrs"), _time(p["timeUnixNano"]).alias("ts")))


def logs_from(payload: DataFrame) -> DataFrame:
    """One row per log record; of the body only its length in bytes is kept."""
    i = F.col("i")
    body = i["body"]
    text = F.coalesce(body["stringValue"], body["intValue"], stringify_double(body["doubleValue"]),
                      body["boolValue"].cast("string"), body["arrayValue"], body["kvlistValue"], body["bytesValue"])
    return _scopes(payload, "resourceLogs", "scopeLogs", "logRecords").select(
        "service", "resource", "scope", F.coalesce(i["severityText"], F.lit("")).alias("severity_text"),
        normalize_severity(i["severityNumber"].try_cast("int"), i["severityText"]).alias("severity_number"),
        _id(i["traceId"]).isNotNull().alias("has_trace_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).alias("body_len"),
        attribute_map(i["attributes"]).alias("attrs"),
        F.coalesce(_time(i["timeUnixNano"]), _time(i["observedTimeUnixNano"])).alias("ts"))


FLATTEN = {"span": spans_from, "metric": metric_points_from, "log": logs_from}


def _payload(reader, signal: str, path: str, multiline: bool) -> DataFrame:
    return reader.schema(SCHEMAS[signal]).option("multiLine", multiline).option("mode", "FAILFAST").json(path)


def read_otlp_traces(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spans_from(_payload(spark.read, "span", path, multiline))


def read_otlp_metrics(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return metric_points_from(_payload(spark.read, "metric", path, multiline))


def read_otlp_logs(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return logs_from(_payload(spark.read, "log", path, multiline))


def stream_otlp(spark: SparkSession, signal: str, path: str, multiline: bool = False,
                max_files: int | None = None) -> DataFrame:
    """Continuous intake of one signal from a directory."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return FLATTEN[signal](_payload(reader, signal, path, multiline))


def otlp_from_messages(messages: DataFrame, signal: str, value: str = "value") -> DataFrame:
    """The same rows from message values, e.g. of a Kafka topic (batch or stream)."""
    parsed = F.from_json(F.col(value).cast("string"), SCHEMAS[signal], {"mode": "FAILFAST"})
    return FLATTEN[signal](messages.select(parsed.alias("m")).select("m.*"))
