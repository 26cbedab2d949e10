import json

import pytest

from obsgauge.operators import runhealth, scoring
from obsgauge.operators import traces as trace_ops
from obsgauge.plans.catalogue import rule
from obsgauge.plans.flows import Scoring
from obsgauge.sources import otlp, snapshots
from util import rows


def kv(**attrs):
    def value(v):
        if isinstance(v, bool):
            return {"boolValue": v}
        if isinstance(v, int):
            return {"intValue": str(v)}
        if isinstance(v, float):
            return {"doubleValue": v}
        if isinstance(v, list):
            return {"arrayValue": {"values": v}}
        return {"stringValue": v}

    return [{"key": k.replace("__", "."), "value": value(v)} for k, v in attrs.items()]


def write(tmp_path, name, *docs):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def trace_doc(service, *spans, **res):
    return {"resource": {"attributes": kv(**({"service__name": service} if service is not None else {}), **res)},
            "scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": list(spans)}]}


def span(trace, sid, parent="", kind=2, **more):
    return {"traceId": trace, "spanId": sid, "parentSpanId": parent, "name": f"op {sid}", "kind": kind,
            "startTimeUnixNano": "1704067200000000000", **more}


@pytest.fixture()
def traces(spark, tmp_path):
    doc = {"resourceSpans": [
        trace_doc("pay", span("aa", "02", "01", status={"code": 2}), deployment__environment__name="prod"),
        trace_doc("front", span("aa", "01", "0000000000000000", "SPAN_KIND_CLIENT", attributes=kv(n=3, f=1.5, g=2.0, b=True, l=[1])))]}
    other = {"resourceSpans": [trace_doc(None, span("bb", "09")), trace_doc(7, span("bb", "08", "09")), trace_doc("", span("cc", "07", "x"))]}
    return otlp.read_otlp_traces(spark, write(tmp_path, "traces.json", doc, other))


def test_spans(traces):
    got = {r["span_id"]: r for r in traces.collect()}
    assert {k: r["service"] for k, r in got.items()} == {"02": "pay", "01": "front", "09": "<unknown>", "08": "<unknown>", "07": "<unknown>"}
    assert got["01"]["parent_span_id"] is None and got["01"]["kind"] == "client" and got["02"]["kind"] == "server"
    assert (got["02"]["status"], got["01"]["status"]) == ("error", "unset")
    assert got["01"]["attrs"] == {"n": "3", "f": "1.5", "g": "2", "b": "true", "l": '{"values": [1]}'}
    assert got["08"]["resource"] == {"service.name": "7"} and got["09"]["resource"] == {}
    assert got["02"]["scope"]["name"] == "lib" and got["02"]["ts"].year == 2024


def test_repeated_keys_keep_the_last_value(spark, tmp_path):
    attrs = [*kv(a="1", b="2"), *kv(a="3"), {"value": {"stringValue": "no key"}}]
    doc = {"resourceSpans": [trace_doc("s", span("aa", "01", attributes=attrs), span("", "02", "01"), span("", "01"))]}
    df = otlp.read_otlp_traces(spark, write(tmp_path, "dup.json", doc))
    assert df.where("trace_id = 'aa'").first()["attrs"] == {"a": "3", "b": "2"}
    # spans without a trace id share one trace and still find their parents
    assert rows(trace_ops.trace_health(df)) == [("s", 2, 0.0, 0.0)]


def test_spans_score(spark, traces):
    rules = [rule(r) for r in ("RES-005", "EXT-RES-003", "SPA-004", "SPA-002", "EXT-SPA-002")]
    s = Scoring(spark, {"span": traces}, rules)
    s.check()
    got = {(r["service"], r["rule_id"]): r["passed"] for r in s.results.collect()}
    assert got["front", "SPA-004"] is False and got["pay", "SPA-004"] is True
    assert got["pay", "EXT-RES-003"] is True and got["front", "EXT-RES-003"] is False
    assert got["<unknown>", "RES-005"] is False and got["pay", "SPA-002"] is True and got["<unknown>", "SPA-002"] is False
    assert rows(scoring.graph_edges(s.edges)) == [("front", "pay", 1)]


def test_metric_shapes(spark, tmp_path):
    def metric(name, shape, *points, **more):
        return {"name": name, shape: {"dataPoints": list(points)}, **more}

    p = {"attributes": kv(k="v"), "timeUnixNano": "1704067200000000000"}
    ex = {**p, "exemplars": [{"traceId": "aa"}]}
    doc = {"resourceMetrics": [{"resource": {"attributes": kv(service__name="s")}, "scopeMetrics": [{"metrics": [
        metric("g", "gauge", p, p, unit="s"), metric("c", "sum", ex), metric("h", "histogram", {
            **ex, "explicitBounds": [0.5, 1.0], "bucketCounts": ["1", "2", "3"]}), metric("hb", "histogram", p),
        metric("e", "exponentialHistogram", ex), metric("q", "summary", ex), {"name": "unset"}]}]}]}
    df = otlp.read_otlp_metrics(spark, write(tmp_path, "m.json", doc))
    assert rows(df, "name", "type", "unit", "exemplar_count") == [
        ("c", "sum", "", 1), ("e", "exponential_histogram", "", 1), ("g", "gauge", "s", 0), ("g", "gauge", "s", 0),
        ("h", "histogram", "", 1), ("hb", "histogram", "", 0), ("q", "summary", "", 0)]
    h = {r["name"]: r for r in df.collect()}
    assert h["h"]["bucket_bounds"] == [0.5, 1.0] and h["h"]["bucket_counts"] == [1, 2, 3]
    assert h["hb"]["bucket_bounds"] == [] and h["g"]["bucket_bounds"] is None and h["g"]["attrs"] == {"k": "v"}


def test_logs(spark, tmp_path):
    doc = {"resourceLogs": [{"resource": {"attributes": kv(service__name="s")}, "scopeLogs": [{"logRecords": [
        {"severityText": "warning", "body": {"stringValue": "hé"}, "traceId": "ab", "timeUnixNano": "1704067200000000000"},
        {"severityNumber": 5, "body": {"intValue": "123"}, "traceId": "00000000000000000000000000000000",
         "observedTimeUnixNano": "1704067200000000000"}, {}]}]}]}
    df = otlp.read_otlp_logs(spark, write(tmp_path, "l.json", doc))
    assert rows(df, "severity_number", "has_trace_id", "body_len", "severity_text") == [
        (0, False, 0, ""), (13, True, 3, "warning"), (5, False, 3, "")]
    assert "body" not in df.columns


def test_messages_and_stream_equal_files(spark, tmp_path, traces):
    doc = {"resourceSpans": [trace_doc("s", span("aa", "01"), span("aa", "02", "01"))]}
    path = write(tmp_path, "one.json", doc)
    batch = otlp.read_otlp_traces(spark, path)
    messages = spark.createDataFrame([(json.dumps(doc).encode(),)], "value binary")
    cols = ["service", "trace_id", "span_id", "parent_span_id"]
    assert rows(otlp.otlp_from_messages(messages, "span"), *cols) == rows(batch, *cols)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(doc))
    q = (otlp.stream_otlp(spark, "span", str(folder)).writeStream.format("memory").queryName("intake")
         .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    q.awaitTermination()
    assert rows(spark.table("intake"), *cols) == rows(batch, *cols)


def test_bad_payload_stops_the_job(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text('{"resourceSpans": [{"resource": ')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        otlp.read_otlp_traces(spark, str(path)).collect()


def test_multiline_payload(spark, tmp_path):
    doc = {"resourceSpans": [trace_doc("s", span("aa", "01"))]}
    path = tmp_path / "pretty.json"
    path.write_text(json.dumps(doc, indent=2))
    assert otlp.read_otlp_traces(spark, str(path), multiline=True).count() == 1


def test_long_values_stay_apart(spark, tmp_path):
    """Values and services that differ after hundreds of bytes are different ones."""
    doc = {"resourceSpans": [trace_doc("s" * 300 + str(k), span("aa", f"{k + 1:02}", attributes=kv(v="x" * 400 + str(k)))) for k in range(50)]}
    got = otlp.read_otlp_traces(spark, write(tmp_path, "long.json", doc))
    assert got.selectExpr("attrs['v'] v").distinct().count() == 50
    assert got.select("service").distinct().count() == 50


def test_unused_resources_are_not_read(spark, tmp_path, traces):
    folder = str(tmp_path / "pq")
    doc = {"resourceSpans": [trace_doc("s", span("aa", "01"))]}
    spark.read.schema(otlp.SCHEMAS["span"]).json(write(tmp_path, "x.json", doc)).write.parquet(folder)
    plan = otlp.spans_from(spark.read.parquet(folder)).select("trace_id", "span_id")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema"):]
    assert "scopeSpans" in scan and "resource:" not in scan


def test_score_snapshots(tables, tmp_path):
    spark, path = tables.spark, str(tmp_path / "scores")
    s = Scoring(spark, {"log": tables.logs()}, [rule("LOG-002"), rule("RES-005")])
    for day in ("2024-01-01 10:00:00", "2024-01-02 10:00:00"):
        snapshots.write_score_snapshot(path, s.scores, s.results, s.findings, scoring.fleet_score(s.scores), day)
    stored = spark.read.parquet(f"{path}/findings")
    assert stored.count() == 2 * s.findings.count()
    last = snapshots.last_snapshot_before(spark.read.parquet(f"{path}/service_scores"), "2024-01-02 10:00:00")
    assert rows(last, "service", "spec_score") == rows(s.scores, "service", "spec_score")
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(snapshot_date") >= 2 and "PartitionFilters: []" not in plan, plan
    assert {str(r[0]) for r in last.select("snapshot_date").distinct().collect()} == {"2024-01-01"}
    assert snapshots.last_snapshot_before(spark.read.parquet(f"{path}/snapshots"), "2024-01-01 10:00:00").count() == 0
    assert rows(snapshots.rule_ratio_history(stored)) == sorted(2 * rows(s.findings, "rule_id", "ratio"), key=repr)


def test_gauges_replace(spark, tmp_path):
    path = str(tmp_path / "g")
    for value in (1.0, 2.0):
        snapshots.write_gauges(path, spark.createDataFrame([(value,)], "value double"))
    assert rows(spark.read.parquet(path)) == [(2.0,)]


def test_aggregate_snapshots_and_ratios(spark, tmp_path):
    agg = [{"Service": "a", "Aggregate": "trace_health", "Fields": {"traces": 4, "orphan_ratio": 0.5}},
           {"Service": "a", "Aggregate": "metric_attribute_cardinality", "Fields": {"metric": "404", "attribute": "5", "cardinality": 9}}]
    for i in range(2):
        (tmp_path / f"aggregates-{i}.json").write_text(json.dumps(agg))
    got = snapshots.read_aggregate_snapshots(spark, str(tmp_path / "aggregates-*.json"))
    assert got.count() == 4
    assert got.where("aggregate = 'metric_attribute_cardinality'").first().asDict() == {
        "service": "a", "aggregate": "metric_attribute_cardinality", "dims": {"metric": "404", "attribute": "5"}, "fields": {"cardinality": 9.0}}
    dist = runhealth.aggregate_distribution(got, measures=["cardinality"]).first()
    assert (dist["n"], dist["median"], dist["top"]) == (2, 9.0, "a/404/5")

    def report(*ratios):
        return {"snapshot": {"fleet_score": 1.0, "services": [{"service": f"s{i}", "findings": [
            {"rule_id": "R", "stats": {"observed": 10, "violations": 1, "ratio": r}}]} for i, r in enumerate(ratios)]}}

    (tmp_path / "report-000.json").write_text(json.dumps(report(0.1, 0.4), indent=1))
    (tmp_path / "report-001.json").write_text(json.dumps(report(0.2)))
    (tmp_path / "report-002.json").write_text('{"snapshot": {"services": [')
    ratios = snapshots.read_report_ratios(spark, str(tmp_path / "report-*.json"))
    assert rows(ratios, "rule_id", "ratio") == [("R", 0.1), ("R", 0.2), ("R", 0.4)]
    bad = snapshots.unreadable_reports(spark, str(tmp_path / "report-*.json")).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["reason"]) for r in bad] == [("report-002.json", "malformed")]
    assert rows(runhealth.report_ratio_summary(ratios)) == [("R", 3, 1, 0.2, 0.4)]


def test_soak_metrics(spark, tmp_path):
    path = tmp_path / "metrics.csv"
    path.write_text("ts,items_logs,rss_bytes,pairs_tracked,evictions_total,items_traces,items_metrics,extra\n"
                    "2024-01-01T00:00:00Z,1,100,5,0,2,3,x\n2024-01-01T00:01:00Z,oops,110,,0,2,3,x\n")
    assert rows(snapshots.read_soak_metrics(spark, str(path)), "rss", "pairs", "items") == [(100.0, 5.0, 6.0), (110.0, 0.0, 5.0)]
    assert runhealth.run_continuity(snapshots.read_soak_metrics(spark, str(path))).first()["run"] == "metrics"
    assert runhealth.run_continuity(snapshots.read_soak_metrics(spark, str(path), "r7")).first()["samples"] == 2
    path.write_text("ts,items_logs,rss_bytes,pairs_tracked,evictions_total,items_traces,items_metrics\n")
    with pytest.raises(ValueError, match="no samples"):
        snapshots.read_soak_metrics(spark, str(path))
    path.write_text("ts,items_logs\n2024-01-01T00:00:00Z,1\n")
    with pytest.raises(ValueError, match="no column"):
        snapshots.read_soak_metrics(spark, str(path))




def test_messages_are_parsed_once(spark):
    """No filter of an explode is put under the parsing, and empty lists still give no rows."""
    from obsgauge.sources.otlp import otlp_from_messages

    one = '{"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "a1", "spanId": "b1"}]}]}]}'
    empty = ['{}', '{"resourceSpans": []}', '{"resourceSpans": [{}]}', '{"resourceSpans": [{"scopeSpans": []}]}', '{"resourceSpans": [{"scopeSpans": [{"spans": []}]}]}', None]
    messages = spark.createDataFrame([(v,) for v in [one, *empty]], "value string")
    got = otlp_from_messages(messages, "span")
    assert [r.trace_id for r in got.collect()] == ["a1"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
