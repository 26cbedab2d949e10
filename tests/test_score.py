import pytest
from pyspark.sql import functions as F

from obsgauge.functions.attributes import redact_evidence
from obsgauge.operators import rules as rule_ops
from obsgauge.operators import scoring, traces
from obsgauge.plans.catalogue import (
    DEFAULT_RULES,
    ITEM_RULES,
    Rule,
    catalogue_frame,
    check_criteria,
    rule,
    rule_from_row,
    rules_merge,
    with_params,
)
from obsgauge.plans.flows import AGGREGATES, Scoring, register_aggregate
from util import rows

SPAN = "trace_id string, span_id string, parent_span_id string, service string, ts timestamp"


def spans(spark, *data):
    full = [(*d, None) if len(d) == 4 else d for d in data]
    return spark.createDataFrame(full, "trace_id string, span_id string, parent_span_id string, service string, t string"
                                 ).select("trace_id", "span_id", "parent_span_id", "service",
                                          F.col("t").cast("timestamp").alias("ts"))


def test_trace_health_half_broken(spark):
    df = spans(spark, ("t1", "a", None, "s"), ("t1", "b", "a", "s"), ("t2", "c", "gone", "s"))
    assert rows(traces.trace_health(df)) == [("s", 2, 0.5, 0.5)]


def test_break_is_charged_where_it_is_seen(spark):
    # front → back resolves across services; the worker in t2 points at nothing
    df = spans(spark, ("t1", "1", None, "front"), ("t1", "2", "1", "back"),
               ("t2", "3", "lost", "worker"), ("t2", "4", "3", "back"))
    assert rows(traces.trace_health(df)) == [("back", 2, 0.0, 0.0), ("front", 1, 0.0, 0.0), ("worker", 1, 1.0, 1.0)]


def test_rootless_cycle_is_charged_to_all(spark):
    df = spans(spark, ("t", "1", "2", "a"), ("t", "2", "1", "b"))
    assert rows(traces.trace_health(df)) == [("a", 1, 0.0, 1.0), ("b", 1, 0.0, 1.0)]


def test_edges_count_traces(spark):
    df = spans(spark, *[x for t in ("t1", "t2") for x in ((t, "1", None, "a"), (t, "2", "1", "b"), (t, "3", "1", "b"))],
               ("t2", "4", "2", "c"), ("t3", "9", "gone", "b"), ("t4", "1", None, "a"), ("t4", "2", "1", "a"))
    assert rows(traces.service_dependency(df)) == [("a", "b", 2), ("b", "c", 1)]


def test_duplicate_span_belongs_to_earliest(spark):
    df = spans(spark, ("t", "1", None, "late", "2024-01-01 00:01:00"), ("t", "1", None, "early", "2024-01-01 00:00:00"),
               ("t", "2", "1", "x", "2024-01-01 00:02:00"))
    assert rows(traces.service_dependency(df)) == [("early", "x", 1)]


def test_windowed_health_judges_closed_windows(spark):
    df = spans(spark, ("t1", "1", None, "a", "2024-01-01 00:59:00"), ("t1", "2", "1", "a", "2024-01-01 01:01:00"),
               ("t2", "3", None, "a", "2024-01-01 01:30:00"))
    got = traces.trace_health(df, "1 hour", closed_before="2024-01-01 01:30:00")
    assert [(r["window_start"].hour, r["traces"]) for r in got.collect()] == [(0, 1)]


def _results(spark, data):
    """(source, weight, passed) rows of one service."""
    return spark.createDataFrame([("s", f"R{i}", src, w, p) for i, (src, w, p) in enumerate(data)],
                                 "service string, rule_id string, source string, weight int, passed boolean")


def test_score_formula(spark):
    data = []
    for weight, passed, total in ((40, 4, 8), (30, 8, 10), (20, 6, 8), (10, 1, 5)):
        data += [("spec", weight, i < passed) for i in range(total)]
    r = scoring.service_scores(_results(spark, data)).first()
    assert round(r["spec_score"], 4) == 63.8554 and r["extension_score"] is None


def test_scores_do_not_mix_sources(spark):
    r = scoring.service_scores(_results(spark, [("extension", 40, False)])).first()
    assert (r["spec_score"], r["extension_score"]) == (100.0, 0.0)
    empty = scoring.service_scores(_results(spark, []))
    assert rows(scoring.score_gate(empty, 50.0)) == [(100.0, 0, False, True)]


def test_eval_errors_apart_for_items_and_violations_for_aggregates(spark):
    items = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "7")], "service string, v string")
    r = Rule("T", "extension", "t", "metric", "low", "try_cast(v as int) < 5")
    assert rows(rule_ops.item_rollup({"metric": items}, [r])) == [("a", "T", 3, 1, 1)]
    r = Rule("T", "extension", "t", "metric", "low", "try_cast(v as int) < 5", aggregate="x")
    assert rows(rule_ops.aggregate_rollup({"x": items}, [r])) == [("a", "T", 3, 2, 1)]


def test_threshold_is_inclusive(spark):
    roll = spark.createDataFrame([("a", "EXT-LOG-001", 4, 2, 0), ("b", "EXT-LOG-001", 4, 3, 0)],
                                 "service string, rule_id string, observed bigint, violations bigint, eval_errors bigint")
    assert rows(rule_ops.rule_results(roll, catalogue_frame(spark)), "service", "passed") == [("a", True), ("b", False)]


def test_rule_arguments_are_checked():
    for bad in (dict(target="host"), dict(impact="huge"), dict(source="mine"), dict(criteria=" "),
                dict(criteria="x < :limit")):
        args = dict(rule_id="X", source="spec", name="x", target="span", impact="low", criteria="true") | bad
        with pytest.raises(ValueError):
            Rule(**args)


def test_criteria_must_be_boolean(spark):
    df = spark.createDataFrame([("a", 1)], "service string, v int")
    check_criteria(Rule("X", "spec", "x", "span", "low", "v > 0"), df)
    with pytest.raises(TypeError):
        check_criteria(Rule("X", "spec", "x", "span", "low", "v + 1"), df)


def test_params_do_not_touch_literals():
    r = Rule("X", "spec", "x", "span", "low", "name = ':a' and name rlike :p and v::int < :a",
             params={"a": 3, "p": r"x'\d"})
    assert r.criteria_sql() == r"name = ':a' and name rlike 'x\'\\d' and v::int < 3"


def test_default_criteria_resolve(tables):
    Scoring(tables.spark, tables.signals(names=True, times=True)).check()


def test_merge_and_round_trip(spark):
    changed = with_params(rule("MET-001"), max_cardinality=60)
    merged = rules_merge(catalogue_frame(spark), catalogue_frame(spark, [changed]))
    got = {r["rule_id"]: rule_from_row(r) for r in merged.collect()}
    assert len(got) == len(DEFAULT_RULES) and got["MET-001"] == changed
    assert got["LOG-001"] == rule("LOG-001")


def test_verified_overrides_and_adds(spark):
    cat = catalogue_frame(spark)
    roll = spark.createDataFrame([("a", "RES-005", 5, 5, 0), ("a", "LOG-002", 5, 1, 0)],
                                 "service string, rule_id string, observed bigint, violations bigint, eval_errors bigint")
    verified = spark.createDataFrame([("a", "RES-005", True, None), ("new", "RES-005", True, None)],
                                     "service string, rule_id string, passed boolean, series bigint")
    out = scoring.apply_verified(rule_ops.rule_results(roll, cat), verified, cat)
    assert rows(out, "service", "rule_id", "passed", "confidence") == [
        ("a", "LOG-002", False, "sampled"), ("a", "RES-005", True, "verified"), ("new", "RES-005", True, "verified")]


def test_verify_cardinality_any_failing_pair_fails(spark):
    flagged = spark.createDataFrame([("a", "m", "x"), ("a", "m", "y"), ("b", "m", "x"), ("c", "m", "unknown")],
                                    "service string, metric string, attribute string")
    exact = spark.createDataFrame([("m", "x", 5), ("m", "y", 50), ("m", "unknown", 0)],
                                  "metric string, attribute string, series bigint")
    assert rows(scoring.verify_cardinality(flagged, exact, "MET-001", 10)) == [
        ("a", "MET-001", False, 50), ("b", "MET-001", True, 5)]


def test_item_evidence_first_five(spark):
    logs = spark.createDataFrame([("s", f"2024-01-01 00:00:0{i}", str(i), "") for i in range(8)],
                                 "service string, t string, item_id string, severity_text string").select(
        "service", F.col("t").cast("timestamp").alias("ts"), "item_id", "severity_text", F.lit(0).alias("severity_number"),
        F.create_map(F.lit("k"), F.lit("v")).alias("resource")).repartition(4)
    kept = scoring.item_evidence({"log": logs}, [rule("LOG-002")], 5, bin_s=2)
    shown = ["rank", "item_id", "ts", "kind"]
    assert rows(kept, *shown) == rows(scoring.item_evidence({"log": logs}, [rule("LOG-002")], 5, bin_s=None), *shown)
    timeless = logs.withColumn("ts", F.when(F.col("item_id") != "6", F.col("ts")))
    assert rows(scoring.item_evidence({"log": timeless}, [rule("LOG-002")], 5), "item_id") == [(str(i),) for i in (0, 1, 2, 3, 6)]
    assert rows(kept, "rank", "item_id") == [(i + 1, str(i)) for i in range(5)]
    redacted = scoring.evidence_lists(kept).select(redact_evidence(F.col("evidence")).alias("e")).first()["e"]
    assert len(redacted) == 5 and redacted[0]["attrs"] == {"k": "<redacted>"} and redacted[0]["summary"] == ""


def test_map_side_limit_in_plan(tables):
    text = scoring.item_evidence({"log": tables.logs()}, ITEM_RULES, 5)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_remediation_params(spark):
    found = spark.createDataFrame([
        ("a-b", "R", 0.125), ("c", "R", 0.0)], "service string, rule_id string, ratio double")
    largest = spark.createDataFrame([("a-b", "R", 12.0, "m", "span.name", 12)],
                                    "service string, rule_id string, quantity double, metric string, attribute string, cardinality bigint")
    assert rows(scoring.remediation_params(found, largest)) == [
        ("a-b", "R", "a_b", "m", "REPLACE_WITH_ATTRIBUTE_KEY", "12", "12%"),
        ("c", "R", "c", "REPLACE_WITH_METRIC_NAME", "REPLACE_WITH_ATTRIBUTE_KEY", "", "")]


def test_registered_aggregate(tables):
    register_aggregate("log_volume", lambda s: s["log"].groupBy("service").agg(F.count(F.lit(1)).alias("records")))
    try:
        own = Rule("TEAM-9", "extension", "quiet", "log", "low", "records < :n", aggregate="log_volume", params={"n": 100})
        s = Scoring(tables.spark, {"log": tables.logs()}, [own])
        s.check()
        want = rows(tables.logs().groupBy("service").count().select("service", F.col("count") < 100))
        assert rows(s.results, "service", "passed") == want
        with pytest.raises(ValueError):
            register_aggregate("log_volume", None)
    finally:
        AGGREGATES.pop("log_volume")


def test_unknown_aggregate_is_refused(tables):
    own = Rule("TEAM-9", "extension", "x", "log", "low", "n < 1", aggregate="nothing")
    with pytest.raises(LookupError):
        Scoring(tables.spark, {"log": tables.logs()}, [own]).aggregates


def test_result_does_not_depend_on_partitions(tables):
    def run(parts):
        sig = {k: v.repartition(parts) for k, v in tables.signals(names=True).items()}
        return rows(Scoring(tables.spark, sig).scores)

    old = tables.spark.conf.get("spark.sql.shuffle.partitions")
    try:
        tables.spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = run(1)
        tables.spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert run(7) == one
    finally:
        tables.spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sketches_merge_within_five_percent(spark):
    from obsgauge.operators import aggregates as agg

    df = spark.range(40_000).select((F.col("id") % 4).alias("part"), (F.col("id") % 9_000).cast("string").alias("value"),
                                    F.lit("k").alias("key"))
    merged = agg.merge_sketches(agg.cardinality_sketches(df, ["key", "part"]), ["key"]).first()["estimate"]
    assert abs(merged - 9_000) <= 450


def test_windowed_trace_health_deals_spans_by_their_number(tables, monkeypatch):
    """A task holds a bounded number of spans however well their bytes compress."""
    from obsgauge.plans.registry import score

    want = rows(score.trace_health_windowed(tables))
    monkeypatch.setattr(score, "SPANS_A_TASK", 500)
    df = score.trace_health_windowed(tables)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert rows(df) == want
    n = tables.read("lineitem").count()
    spans = tables.spans(times=True, tasks=n // 500 + 1)
    per_task = spans.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 1000


def test_written_results_are_what_scores_and_findings_read(spark, tables):
    """A snapshot's tables come from one run over the signals."""
    lazy = Scoring(spark, tables.signals(names=True))
    s = Scoring(spark, tables.signals(names=True)).write_results()
    for df in (s.results, s.scores, s.findings):
        assert df.inputFiles() and all("rule-results-" in f for f in df.inputFiles())
    assert rows(s.scores) == rows(lazy.scores)
    assert rows(s.findings) == rows(lazy.findings)
