import pytest
from pyspark.sql import functions as F

from obsgauge.operators import spend
from obsgauge.plans.flows import showback
from obsgauge.sources import backend
from util import rows

MONTH_S = 730 * 3600
RATES = spend.Rates(0.5, 0.2, {"logs": 0.25}, {"STANDARD": 0.023, "STANDARD_IA": 0.0125, "GLACIER": 0.03})


def usage(spark, *data):
    return spark.createDataFrame(list(data), "service string, team string, signal string, ingest_bytes bigint, active_series bigint")


def stored(spark, *data):
    return spark.createDataFrame(list(data), "storage_class string, bytes bigint")


def test_one_month(spark):
    got = spend.price_lines(usage(spark, ("a", "", "metrics", 10**9, 2 * 10**6)), RATES, MONTH_S)
    assert rows(got) == [("a", "", "metrics", 0.5, 0.4, 0.9)]


def test_one_hour_scales_bytes_only(spark):
    got = spend.price_lines(usage(spark, ("a", "", "metrics", 10**9, 10**6)), RATES, 3600).first()
    assert (got["ingest_monthly"], got["active_series_monthly"]) == (365.0, 0.2)
    assert spend.monthly_factor(0) == 1.0


def test_signal_rate_and_grouping(spark):
    got = spend.price_lines(usage(spark, ("a", "t", "logs", 10**9, 0), ("a", "t", "logs", 10**9, 0), ("a", "u", "logs", 4 * 10**9, 0),
                                  ("a", "t", "traces", 2 * 10**9, 0)), RATES, 0)
    assert rows(got, "team", "signal", "total_monthly") == [("t", "logs", 0.5), ("t", "traces", 1.0), ("u", "logs", 1.0)]


def test_storage_and_lifecycle(spark):
    objects = backend.storage_by_class(stored(spark, ("", 10**9), ("STANDARD", 10**9), ("ODD", 5), (None, 10**9)))
    assert rows(objects) == [("ODD", 5), ("STANDARD", 3 * 10**9)]
    assert rows(spend.price_storage(objects, RATES), "storage_class", "monthly") == [("ODD", 0.0), ("STANDARD", pytest.approx(0.069))]
    moves = spend.lifecycle_savings(objects, RATES)
    assert [(r["from_class"], r["to_class"], round(r["savings_monthly"], 6)) for r in moves.collect()] == [
        ("STANDARD", "STANDARD_IA", 0.0315)]


def test_trend(spark):
    def lines(*d):
        return spark.createDataFrame(list(d), "service string, team string, signal string, total_monthly double")

    got = spend.cost_trend(lines(("a", "", "logs", 13.0), ("new", "", "logs", 1.0)), lines(("a", "", "logs", 10.0), ("old", "", "logs", 2.0)))
    assert rows(got) == [("a", "", "logs", 13.0, 10.0, 3.0, 30.0), ("new", "", "logs", 1.0, 0.0, 1.0, 0.0),
                         ("old", "", "logs", 0.0, 2.0, -2.0, -100.0)]


def test_budget(spark):
    total = spark.createDataFrame([(10.0,)], "total_monthly double")
    assert [spend.budget_gate(total, x).first()["over_budget"] for x in (0.0, 9.9, 10.0)] == [False, True, False]


def test_rates_are_checked():
    with pytest.raises(ValueError):
        spend.Rates(-1.0, 0.0)
    with pytest.raises(ValueError):
        spend.Rates(1.0, 0.0, storage_gb_month={"X": -0.1})


def test_usage_needs_a_source(spark):
    with pytest.raises(ValueError):
        spend.gather_usage()
    series = spark.createDataFrame([("a", 5)], "service string, active_series bigint")
    logs = spark.createDataFrame([("a", 7)], "service string, bytes bigint")
    assert rows(spend.gather_usage(series, logs)) == [("a", "", "logs", 7, 0), ("a", "", "metrics", 0, 5)]


def test_finding_prices(spark):
    from obsgauge.operators import scoring
    from obsgauge.plans.catalogue import catalogue_frame, rule, with_params

    found = spark.createDataFrame([("a", "MET-001", None), ("b", "MET-001", 1_000_000), ("c", "MET-001", None), ("d", "LOG-002", None)],
                                  "service string, rule_id string, verified_series bigint")
    # Eight violations; the largest is not among the latest five.
    sizes = [3_000_000, 100, 200, 300, 400, 500, 600, 700]
    violations = spark.createDataFrame(
        [("a", f"m{k}", "k", k, n) for k, n in enumerate(sizes)] + [("b", "m", "k", 0, 2_000_000), ("c", "m", "k", 0, 1)],
        "service string, metric string, attribute string, window_start int, cardinality bigint")
    strict = with_params(rule("MET-001"), max_cardinality=90)
    largest = scoring.largest_violations(violations, [strict], "metric_attribute_cardinality", "cardinality", ["metric", "attribute"])
    got = spend.price_findings(found, catalogue_frame(spark), RATES, largest)
    assert rows(got, "service", "estimated_monthly_cost") == sorted(
        [("a", pytest.approx(0.6)), ("b", 0.2), ("c", None), ("d", None)], key=lambda r: r[0])


def test_showback_history(spark, tmp_path):
    path = str(tmp_path / "costs")
    objects = stored(spark, ("STANDARD", 10**12))
    first = showback(spark, usage(spark, ("a", "", "logs", 4 * 10**9, 0)), objects, RATES, MONTH_S, "2024-01-01 00:00:00", path)
    assert first.trend is None and first.lifecycle.count() == 1
    second = showback(spark, usage(spark, ("a", "", "logs", 8 * 10**9, 0)), objects, RATES, MONTH_S, "2024-01-08 00:00:00", path)
    assert rows(second.trend) == [("a", "", "logs", 2.0, 1.0, 1.0, 100.0)]
    assert second.total_delta.first()["total_delta"] == pytest.approx(1.0)
    third = showback(spark, usage(spark, ("a", "", "logs", 8 * 10**9, 0)), objects, RATES, MONTH_S, "2024-01-15 00:00:00", path)
    assert third.total_delta.first()["total_delta"] == pytest.approx(0.0)
    assert spark.read.parquet(path).select("snapshot_date").distinct().count() == 3
    # a run dated before all others meets no baseline
    assert showback(spark, usage(spark, ("a", "", "logs", 1, 0)), objects, RATES, MONTH_S, "2023-01-01 00:00:00", path).trend is None


def test_log_bytes_window(spark):
    logs = spark.createDataFrame([("a", "2024-01-01 00:00:00", 5), ("a", "2024-01-02 00:00:00", 7), ("", "2024-01-02 00:00:00", 9)],
                                 "service string, t string, body_len int").withColumn("ts", F.col("t").cast("timestamp"))
    assert rows(backend.log_bytes_by_service(logs, "2024-01-02 00:00:00", 86400)) == [("a", 7)]
