import random

import pytest
from pyspark.sql import functions as F

from obsgauge.functions import attributes as attr
from obsgauge.functions.ranks import last_rank, lower_median, nearest_rank, order_statistics, robust_stats
from obsgauge.functions.runs import BLOCK, consecutive_runs
from obsgauge.functions.timebins import overlapping, points_in_intervals
from util import rows


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_truncate_keeps_whole_characters(spark):
    texts = ["", "a" * 256, "a" * 257, "é" * 128, "é" * 129, "a" + "é" * 128, "€" * 100, "😀" * 70, "ab" + "😀" * 70]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", attr.truncate_attr(F.col("t"), 256).alias("c"))
    for t, cut in df.collect():
        want = t.encode()[:256].decode("utf-8", "ignore")
        assert cut == want


def test_severity(spark):
    data = [(0, "trace", 1), (0, "Debug", 5), (0, "INFO", 9), (0, "warn", 13), (0, "WARNING", 13), (0, "error", 17),
            (0, "fatal", 21), (0, "", 0), (0, None, 0), (None, "info", 9), (10, "error", 10)]
    df = spark.createDataFrame(data, "n int, t string, want int")
    assert all(r["x"] == r["want"] for r in df.withColumn("x", attr.normalize_severity(F.col("n"), F.col("t"))).collect())


def test_names_and_labels(spark):
    assert one(spark, attr.label_key(F.create_map(F.lit("b"), F.lit('x"y'), F.lit("a"), F.lit("1\\2")))) == \
        '{a="1\\\\2",b="x\\"y"}'
    assert one(spark, attr.entity_key(F.lit(" Pod "), F.lit(None).cast("string"), F.lit("Cart"))) == "pod//cart"
    assert one(spark, attr.safe_label(F.lit("a-b.c/1"))) == "a_b_c_1"
    assert one(spark, attr.safe_label(F.lit(""))) == "service"
    assert sorted(one(spark, attr.job_services(F.lit("shop/prod/cart")))) == ["cart", "shop/prod/cart"]
    assert one(spark, attr.service_of(F.lit(""))) == "<unknown>"
    assert one(spark, attr.span_kind_name(F.lit("SPAN_KIND_SERVER"))) == "server"
    assert one(spark, attr.span_kind_name(F.lit(9))) == "unspecified"
    assert one(spark, attr.status_name(F.lit(2))) == "error"
    assert one(spark, attr.stringify_double(F.lit(3.0))) == "3"
    assert one(spark, attr.bucket_signature(F.array(F.lit(0.5), F.lit(1.0)))) == "0.5,1.0"


@pytest.mark.parametrize("score,band", [(90.0, "Excellent"), (89.9, "Good"), (74.9, "Needs Improvement"), (49.9, "Poor")])
def test_categories(spark, score, band):
    assert one(spark, attr.score_category(F.lit(score))) == band


def test_outcome(spark):
    assert one(spark, attr.outcome(F.lit("x\ny"), F.lit(False))) == "error: x\ny"
    assert one(spark, attr.outcome(F.lit("x"), F.lit(True))) == "budget exhausted"
    assert one(spark, attr.outcome(F.lit(None).cast("string"), F.lit(None).cast("boolean"))) == "diagnosed"


def test_robust_stats_worked_numbers(spark):
    df = spark.createDataFrame([("k", float(v)) for v in [*range(1, 10), 100]], "k string, v double")
    r = robust_stats(df, ["k"], "v").first()
    assert (r["n"], r["median"], r["mad"], r["p90"], r["p99"], r["max"]) == (10, 5.0, 2.0, 9.0, 100.0, 100.0)


def test_order_statistics_random(spark):
    rng = random.Random(7)
    data = [(k, rng.choice([rng.gauss(0, 1000), float(rng.randint(-3, 3)), 0.5])) for k in "abc"
            for _ in range({"a": 1, "b": 2, "c": 700}[k])]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {
        "med": lower_median, "p90": nearest_rank(90.0), "p1": nearest_rank(1.0), "max": last_rank}).collect()}
    for k in "abc":
        s = sorted(v for kk, v in data if kk == k)
        n = len(s)

        def at(p):
            return s[min(max(int(p / 100 * n + 0.5) - 1, 0), n - 1)]

        assert got[k]["n"] == n
        assert (got[k]["med"], got[k]["p90"], got[k]["p1"], got[k]["max"]) == (s[(n - 1) // 2], at(90), at(1), s[-1])


def test_null_keys_are_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 5.0), ("a", 2.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["m"]) for r in order_statistics(df, ["k"], "v", {"m": last_rank}).collect()}
    assert got == {None: (2, 5.0), "a": (1, 2.0)}
    assert {r["k"]: r["mad"] for r in robust_stats(df, ["k"], "v").collect()} == {None: 0.0, "a": 0.0}


def test_hot_bin_is_cut_again(spark):
    """A million values within 1e-5 of each other lie in one bin; the last part holds few of them."""
    df = spark.range(1_000_000).selectExpr("'x' k", "1e9 + id * 0.01 v")
    r = order_statistics(df, ["k"], "v", {"m": lower_median, "p99": nearest_rank(99.0)}).first()
    assert (r["n"], r["m"], r["p99"]) == (1_000_000, 1e9 + 499_999 * 0.01, 1e9 + 989_999 * 0.01)


def test_order_statistics_of_a_narrow_range(spark):
    # all values share one bin of the first cut
    rng = random.Random(5)
    vals = [1.7e9 + rng.random() * 100 for _ in range(999)] + [1.7e9 + 1] * 300
    df = spark.createDataFrame([("k", v) for v in vals], "k string, v double").repartition(3)
    r = order_statistics(df, ["k"], "v", {"m": lower_median, "p99": nearest_rank(99.0), "p2": nearest_rank(2.0)}).first()
    s = sorted(vals)
    assert (r["n"], r["m"], r["p99"], r["p2"]) == (1299, s[649], s[int(0.99 * 1299 + 0.5) - 1], s[int(0.02 * 1299 + 0.5) - 1])


def test_runs_across_blocks(spark):
    rng = random.Random(3)
    positions = {k: sorted(rng.sample(range(4 * BLOCK), 4 * BLOCK - 9)) for k in ("x", "y")}
    positions["z"] = [BLOCK - 1, BLOCK, 2 * BLOCK, 2 * BLOCK + 1, 3 * BLOCK - 1]
    df = spark.createDataFrame([(k, p) for k, ps in positions.items() for p in ps], "k string, p bigint").repartition(7)
    want = []
    for k, ps in positions.items():
        start = prev = ps[0]
        for p in ps[1:]:
            if p != prev + 1:
                want.append((k, start, prev))
                start = p
            prev = p
        want.append((k, start, prev))
    assert rows(consecutive_runs(df, ["k"], "p"), "k", "first_pos", "last_pos") == sorted(want, key=repr)


def test_interval_joins_match_nested_loop(spark):
    rng = random.Random(11)
    ivs = [(i, s := rng.randint(0, 100_000), s + rng.choice([0, 10, 5000, 40_000])) for i in range(40)]
    pts = [(i, rng.randint(0, 140_000)) for i in range(300)]
    iv = spark.createDataFrame(ivs, "iv int, s bigint, e bigint").select(
        "iv", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    pt = spark.createDataFrame(pts, "pt int, t bigint").select("pt", F.timestamp_seconds("t").alias("t"))
    got = rows(points_in_intervals(pt, "t", iv, "s", "e"), "pt", "iv")
    assert got == sorted([(p, i) for p, t in pts for i, s, e in ivs if s <= t <= e], key=repr)
    lone = rows(points_in_intervals(pt, "t", iv.select("s", "e"), "s", "e", how="left_anti"), "pt")
    assert lone == sorted([(p,) for p, t in pts if not any(s <= t <= e for _, s, e in ivs)], key=repr)
    left, right = ivs[:20], ivs[20:]
    a, b = iv.where("iv < 20"), iv.where("iv >= 20")
    got = rows(overlapping(a, "s", "e", b, "s", "e", "iv"))
    assert got == sorted([(i,) for i, s, e in left if any(s < f and e > g for _, g, f in right)], key=repr)


def test_interval_rows_do_not_grow_with_the_length_of_the_interval(spark):
    from obsgauge.functions import timebins

    start = "2023-11-05 07:13:21"
    spans = spark.createDataFrame([(start, s) for s in (0, 1, 59, 60, 3600, 86400 * 30, 86400 * 365, 86400 * 3650)], "s string, n long")
    spans = spans.select(F.col("s").cast("timestamp").alias("s"), (F.col("s").cast("timestamp") + F.make_dt_interval(secs=F.col("n"))).alias("e"), "n")
    noted = spans.select("n", F.size(timebins._spans(F.col("s"), F.col("e"), timebins.own_level(F.col("s"), F.col("e")))).alias("rows"))
    assert all(1 <= r.rows <= 2 for r in noted.collect())
    points = spans.select(F.col("e").alias("t"))
    held = timebins.points_in_intervals(points, "t", spans.select("s", "e"), "s", "e")
    assert held.count() == sum(range(1, 9))  # the interval of each length holds the ends of those up to it
