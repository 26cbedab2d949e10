import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsgauge.operators import calibrate, judge, replay, runhealth, series
from obsgauge.plans.catalogue import catalogue_frame, rule
from obsgauge.plans.flows import backtest_run
from util import rows

T0 = datetime(2024, 5, 1)


def minutes(*m):
    return [T0 + timedelta(minutes=x) for x in m]


def grid(n, step=60):
    return series.Grid(T0, T0 + timedelta(seconds=step * (n - 1)), step)


def at(*m):
    return [x.strftime("%Y-%m-%d %H:%M:%S") for x in minutes(*m)]


def samples_at(spark, *m):
    return spark.createDataFrame([(x,) for x in at(*m)], "t string").select(F.col("t").cast("timestamp").alias("ts"))


def test_segments_start_and_end_on_data(spark):
    got = series.presence_segments(samples_at(spark, 0, 1, 2, 5, 8, 9), grid(10))
    assert rows(got, "first_pos", "last_pos") == [(0, 2), (5, 5), (8, 9)]
    assert rows(series.coverage(got, grid(10))) == [(3, 180.0, 180.0 / 540.0, True)]


def test_presence_lookback(spark):
    got = series.presence_points(samples_at(spark, 3), grid(10), lookback_s=180)
    assert rows(got) == [(3,), (4,), (5,)]
    u = series.usable_start(samples_at(spark, 3, 4), grid(10)).first()
    assert u["usable_from"] == minutes(3)[0] and not u["data_at_end"]


def steps(spark, rule_name, hold, *positions, key="s"):
    return spark.createDataFrame([(rule_name, hold, key, p) for p in positions],
                                 "rule string, for_steps bigint, series string, position bigint")


def segs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "first_pos bigint, last_pos bigint")


def fired(df):
    return [(r["active_at"], r["fired_at"], r["resolved_at"]) for r in df.orderBy("fired_at").collect()]


def test_pending_then_firing(spark):
    got = replay.replay(steps(spark, "R", 5, *range(2, 10)), segs(spark, (0, 20)), ["series"], grid(21))
    assert fired(got) == [tuple(minutes(2, 7, 10))]


def test_short_blip_never_fires(spark):
    assert fired(replay.replay(steps(spark, "R", 5, 2, 3), segs(spark, (0, 20)), ["series"], grid(21))) == []


def test_state_does_not_cross_segments(spark):
    got = replay.replay(steps(spark, "R", 2, *range(0, 12)), segs(spark, (0, 5), (7, 11)), ["series"], grid(12))
    a, b = minutes(0, 2), minutes(7, 9)
    assert fired(got) == [(a[0], a[1], None), (b[0], b[1], None)]


def test_counter_reset_and_gap(spark):
    data = [(0, 10), (1, 15), (2, 3), (5, 7)]
    df = spark.createDataFrame([(t, v) for t, (_, v) in zip(at(*[m for m, _ in data]), data)], "t string, c bigint").select(
        F.lit("s").alias("series"), F.col("t").cast("timestamp").alias("ts"), "c")
    assert rows(series.counter_increases(df, grid(10), ["series"], ["c"]), "position", "c") == [(0, 0), (1, 5), (2, 3), (5, 4)]
    # all readings of one step: compared inside the step
    assert rows(series.counter_increases(df, grid(3, 300), ["series"], ["c"]), "position", "c") == [(0, 0), (1, 5 + 3 + 4)]


def test_windowed_ratio_fills_silent_steps(spark):
    df = spark.createDataFrame(list(zip(at(0, 1, 5), (0, 4, 6), (0, 1, 1))), "t string, n bigint, e bigint").select(
        F.lit("s").alias("series"), F.col("t").cast("timestamp").alias("ts"), "n", "e")
    got = series.windowed_ratio(df, grid(8), ["series"], "e", "n", [120]).where("ratio_120 is not null")
    assert rows(got, "position", "ratio_120") == [(1, 0.25), (2, 0.25), (5, 0.0), (6, 0.0)]


@pytest.mark.parametrize("fraction", [1.0, 0.1])
def test_windowed_ratio_by_definition(spark, fraction):
    draw, points, windows = random.Random(4), 60, [60, 180, 420, 1200]
    data, by_series = [], {}
    for name in "abc":
        n = e = 0
        for minute in sorted(draw.sample(range(-20, points), 30)):
            if draw.random() < 0.1:
                n = e = 0
            if draw.random() < 0.7:
                n, e = n + draw.randint(1, 9), e + draw.randint(0, 3)
            by_series.setdefault(name, []).append((minute, n * fraction, e * fraction))
            data.append((name, minute * 60, n * fraction, e * fraction))
    df = spark.createDataFrame(data, "series string, s long, n double, e double").select(
        "series", F.timestamp_seconds(F.col("s") + F.lit(grid(points).start_us // 1_000_000)).alias("ts"), "n", "e")
    got = {(r["series"], r["position"]): r for r in series.windowed_ratio(df, grid(points), ["series"], "e", "n", windows).collect()}

    def rise(before, now):
        return now - before if now >= before else now

    seen = {name: [(m, rise(bn, n), rise(be, e)) for (_, bn, be), (m, n, e) in zip(r, r[1:])] for name, r in by_series.items()}
    for name, rises in seen.items():
        for p in range(points):
            for w in windows:
                inside = [(n, e) for m, n, e in rises if p - w // 60 < m <= p]
                total = sum(n for n, _ in inside)
                want = sum(e for _, e in inside) / total if total > 1e-9 else None
                have = got[name, p][f"ratio_{w}"] if (name, p) in got else None
                assert have == pytest.approx(want), (name, p, w)


def test_ratio_stretches_grow_with_readings_not_windows(spark):
    df = spark.createDataFrame([("s", 0, 0, 0), ("s", 60, 10, 1), ("s", 86_400, 30, 2)], "series string, s long, n long, e long").select(
        "series", F.timestamp_seconds(F.col("s") + F.lit(grid(8).start_us // 1_000_000)).alias("ts"), "n", "e")
    counts = [series.ratio_changes(df, grid(20_000), ["series"], "e", "n", [60, w]).count() for w in (600, 600_000)]
    assert max(counts) <= 3 * 3


def test_derived_series_refuses_unknown_recordings(spark):
    df = spark.createDataFrame([("up",)], "metric string")
    with pytest.raises(LookupError):
        series.derived_series("a:b:c", df, {})
    assert series.derived_series("up", df, {}).count() == 1
    stored = {"a:b:c": df}
    assert series.derived_series("a:b:c", df, {}, stored) is df
    assert series.derived_series("a:b:c", df, {"a:b:c": lambda d: d.limit(0)}, stored).count() == 0
    assert series.derived_series("a:b:c", df, {"a:b:c": lambda d: d.limit(0)}, stored, prefer_stored=True) is df


def test_burn_rate_defaults():
    fast, slow = replay.burn_rate_alerts("api", 0.999)
    assert fast.windows_s == (300, 3600) and fast.for_s == 120 and abs(fast.threshold - 0.0144) < 1e-12
    assert slow.windows_s == (1800, 21600) and slow.for_s == 900
    with pytest.raises(ValueError):
        replay.burn_rate_alerts("api", 1.0)


def firings(spark, *data):
    return spark.createDataFrame([(r, s, at(m)[0]) for r, s, m in data], "rule string, series string, t string").select(
        "rule", "series", F.col("t").cast("timestamp").alias("fired_at"))


def incidents(spark, *data):
    return spark.createDataFrame([(i, at(a)[0], at(b)[0], exp) for i, a, b, exp in data],
                                 "incident string, s string, e string, expected_alerts array<string>").select(
        "incident", F.col("s").cast("timestamp").alias("start_ts"), F.col("e").cast("timestamp").alias("end_ts"),
        "expected_alerts")


def cover(spark, *pairs):
    return spark.createDataFrame([(at(a)[0], at(b)[0]) for a, b in pairs], "s string, e string").select(
        F.col("s").cast("timestamp").alias("start_ts"), F.col("e").cast("timestamp").alias("end_ts"))


def card(spark, f, i, c, rules, grace=0):
    seconds = c.agg(F.coalesce(F.sum(F.unix_seconds("end_ts") - F.unix_seconds("start_ts")), F.lit(0)).cast("double").alias("covered_s"))
    return {r["rule"]: r for r in judge.scorecard(f, i, c, seconds, rules, grace).collect()}


def test_time_to_detection(spark):
    r = card(spark, firings(spark, ("R", "s", 323)), incidents(spark, ("i", 316, 400, [])), cover(spark, (300, 500)), ["R"])["R"]
    assert (r["detected"], r["mean_ttd_s"], r["missed"], r["false_positives"], r["flappiness"]) == (["i"], 420.0, [], 0, 1.0)


def test_early_firing_counts_as_zero(spark):
    r = card(spark, firings(spark, ("R", "s", 9)), incidents(spark, ("i", 10, 20, [])), cover(spark, (0, 60)), ["R"], 120)["R"]
    assert r["mean_ttd_s"] == 0.0 and r["false_positives"] == 0


def test_pages_per_week(spark):
    r = card(spark, firings(spark, ("R", "s", 5), ("R", "t", 5)), incidents(spark), cover(spark, (0, 60)), ["R"])["R"]
    assert (r["pages_per_week"], r["false_positives"], r["detected"], r["missed"]) == (336.0, 2, [], [])


def test_flappiness(spark):
    r = card(spark, firings(spark, ("R", "s", 11), ("R", "s", 13), ("R", "s", 15)),
             incidents(spark, ("i", 10, 20, [])), cover(spark, (0, 60)), ["R"])["R"]
    assert r["flappiness"] == 3.0


def test_unexpected_rule_misses_but_is_no_false_positive(spark):
    got = card(spark, firings(spark, ("Other", "s", 12)), incidents(spark, ("i", 10, 20, ["Mine"])), cover(spark, (0, 60)),
               ["Mine", "Other"])
    assert (got["Other"]["missed"], got["Other"]["false_positives"]) == (["i"], 0)
    assert (got["Mine"]["missed"], got["Mine"]["firings"]) == (["i"], 0)


def test_uncovered_incident_has_no_verdict(spark):
    r = card(spark, firings(spark, ("R", "s", 105)), incidents(spark, ("i", 100, 110, [])), cover(spark, (0, 60)), ["R"])["R"]
    assert (r["unverifiable"], r["missed"], r["false_positives"]) == (["i"], [], 1)


def detected(spark, *data):
    return spark.createDataFrame(list(data), "rule string, incident string, ttd_s double")


def test_diff(spark):
    d = detected(spark, ("a1", "x", 10.0), ("a2", "x", 5.0), ("a1", "y", 1.0), ("b", "x", 400.0), ("b", "z", 1.0))
    c = judge.compare_sets(d, ["a1", "a2"], ["b"])
    assert rows(judge.diff_lost(c)) == [("y",)] and rows(judge.diff_gained(c)) == [("z",)]
    assert rows(judge.diff_ttd(c)) == [("x", 5.0, 400.0, 395.0)]
    pages = spark.createDataFrame([("a1", 1.0), ("a2", 2.0), ("b", 9.0)], "rule string, pages_per_week double")
    cov = spark.createDataFrame([(60.0,)], "covered_s double")
    other = spark.createDataFrame([(61.0,)], "covered_s double")
    assert rows(judge.diff_verdict(c, pages, ["a1", "a2"], ["b"], cov, cov)) == [(60.0, True, 1, 1, 3.0, 9.0, True)]
    assert judge.diff_verdict(c, pages, ["a1", "a2"], ["b"], cov, other).first()["regression"] is None
    kept = c.where("incident = 'x'")
    verdicts = [judge.diff_verdict(kept, pages, ["a1", "a2"], ["b"], cov, cov, **budget).first()["regression"]
                for budget in ({}, {"max_ttd_regression_s": 300}, {"max_ttd_regression_s": 500}, {"max_pages_per_week": 8})]
    assert verdicts == [False, True, False, True]


def test_run_writes_firings_once(tables, tmp_path):
    from obsgauge.plans.registry import history as h

    args = (h._probe(tables), tables.samples(), tables.incidents(), h.ALERTS, h.hourly(tables), ["service"], "errors_total",
            "requests_total", 300)
    plain = backtest_run(*args)
    stored = backtest_run(*args, firings_path=str(tmp_path / "firings"))
    assert rows(plain.scorecard) == rows(stored.scorecard)
    assert rows(plain.firings) == rows(stored.firings)
    assert stored.caveats.count() == 2
    with pytest.raises(ValueError):
        backtest_run(*args[:3], [h.HIGH_ERR, h.HIGH_ERR], *args[4:])


# --- calibration and run health ---------------------------------------------------------------

def test_proposals(spark):
    agg = spark.createDataFrame(
        [("metric_attribute_cardinality", {"cardinality": float(v)}) for v in (40, 45, 60, 80, 130)]
        + [("resource_attr_cardinality", {"cardinality": float(v)}) for v in (1, 1, 2, 2, 5)],
        "aggregate string, fields map<string,double>")
    ratios = spark.createDataFrame([("EXT-LOG-001", v) for v in (0.52, 0.55, 0.62, 0.70)], "rule_id string, ratio double")
    cat = catalogue_frame(spark)
    got = calibrate.propose_thresholds(agg, ratios, cat)
    assert rows(got, "rule_id", "current", "proposed", "n") == [
        ("EXT-LOG-001", 0.5, 0.76, 4), ("EXT-RES-004", 3.0, 6.0, 5), ("MET-001", 10000.0, 260.0, 5)]
    new = {r["rule_id"]: r for r in calibrate.override_rules(cat, got).collect()}
    assert new["MET-001"]["params"] == {"max_cardinality": "260", "window_s": "3600"}
    assert new["EXT-LOG-001"]["threshold_ratio"] == 0.76 and new["MET-001"]["criteria"] == rule("MET-001").criteria


@pytest.mark.parametrize("value,want", [(260.0, 260.0), (261.0, 270.0), (9.1, 9.1), (0.0, 0.0), (100.0, 100.0), (2041.0, 2100.0)])
def test_two_digit_ceiling(spark, value, want):
    got = spark.range(1).select(calibrate.ceil_two_digits(F.lit(value)).alias("x")).first()["x"]
    assert got == pytest.approx(want)


def run(spark, *data):
    return spark.createDataFrame([("r", at(m)[0], float(rss), float(pairs), float(ev), float(items))
                                  for m, rss, pairs, ev, items in data],
                                 "run string, t string, rss double, pairs double, evictions double, items double").select(
        "run", F.col("t").cast("timestamp").alias("ts"), "rss", "pairs", "evictions", "items")


def test_continuity(spark):
    df = run(spark, (0, 1, 1, 0, 10), (1, 1, 1, 0, 20), (2, 1, 1, 0, 30), (47, 1, 1, 0, 5), (48, 1, 1, 0, 9))
    r = runhealth.run_continuity(df).first()
    assert (r["samples"], r["gaps"], r["longest_gap_s"], r["restarts"], r["segmented"]) == (5, 1, 2700.0, 1, True)
    lone = runhealth.run_continuity(run(spark, (0, 1, 1, 0, 1))).first()
    assert (lone["samples"], lone["gaps"], lone["restarts"], lone["segmented"]) == (1, 0, 0, False)


def test_previous_sample_across_blocks(spark):
    df = run(spark, *[(m, m, 1, 0, m) for m in (0, 1439, 1440, 1441, 4000, 9000)])
    got = runhealth.with_previous(df, ["rss"])
    assert rows(got, "rss", "prev_rss") == sorted(
        [(0.0, None), (1439.0, 0.0), (1440.0, 1439.0), (1441.0, 1440.0), (4000.0, 1441.0), (9000.0, 4000.0)], key=repr)


def test_memory_verdict(spark):
    data = [(m, 10 if m < 120 else 100 if m < 200 else 130, 1, 0, m) for m in range(0, 300, 10)]
    got = {r["warmup_excluded"]: r for r in runhealth.memory_verdict(run(spark, *data)).collect()}
    assert [got[True][c] for c in ("samples", "first_rss", "last_rss", "flat")] == [18, 100.0, 130.0, False]
    assert [got[False][c] for c in ("samples", "first_rss", "last_rss", "flat")] == [30, 10.0, 130.0, False]
    short = runhealth.memory_verdict(run(spark, *data[:8])).collect()
    assert [(r["samples"], r["warmup_excluded"], r["growth_percent"], r["flat"]) for r in short] == [(8, False, 0.0, True)]


def test_throughput(spark):
    r = runhealth.run_throughput(run(spark, (0, 1, 5, 0, 0), (1, 1, 9, 1, 60), (2, 1, 2, 3, 240))).first()
    assert (r["rotated"], r["evictions"], r["elapsed_s"], r["items_per_s"]) == (True, 3.0, 120.0, 2.0)
