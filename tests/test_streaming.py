"""Each streaming operator over available input equals its batch twin on closed windows."""

from pyspark.sql import functions as F

from obsgauge.operators import aggregates as agg
from obsgauge.operators import replay, traces
from obsgauge.operators.rules import item_rollup
from obsgauge.plans.catalogue import ITEM_RULES, rule
from obsgauge.plans.registry import history
from obsgauge.streaming import (
    alert_events,
    export_gauges,
    firings_from_events,
    late_rows,
    read_gauges,
    read_trace_health,
    run_available,
    start_table,
    start_trace_health,
    stream_cardinality,
    stream_rule_rollup,
)
from util import rows


def _stored(df, path, parts=3):
    """The frame as files of a stream source."""
    df.repartition(parts).write.parquet(path)
    spark = df.sparkSession
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def _with_closing_row(df, **values):
    """Adds one row far in the future, so every real window closes."""
    last = df.orderBy("ts").limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    for k, v in values.items():
        last = last.withColumn(k, F.lit(v).cast(df.schema[k].dataType))
    return last


def test_rule_rollup(tables, tmp_path):
    logs, points = tables.logs(), tables.points()
    s_logs, _ = _stored(logs, str(tmp_path / "logs"))
    s_points, _ = _stored(points, str(tmp_path / "points"))
    stream = stream_rule_rollup({"log": s_logs, "metric": s_points}, ITEM_RULES)
    out = str(tmp_path / "out")
    q = (stream.writeStream.outputMode("complete").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "cp"))
         .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start())
    q.awaitTermination()
    batch = item_rollup({"log": logs, "metric": points}, ITEM_RULES)
    cols = ["service", "rule_id", "observed", "violations", "eval_errors"]
    assert rows(tables.spark.read.parquet(out), *cols) == rows(batch, *cols)


def _in_time_order(df, path, cuts):
    """One file per time slice, written in order of time."""
    lo = None
    for i, hi in enumerate([*cuts, None]):
        part = df
        if lo:
            part = part.where(F.col("ts") >= F.lit(lo).cast("timestamp"))
        if hi:
            part = part.where(F.col("ts") < F.lit(hi).cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)
        lo = hi
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_cardinality_and_late_rows(tables, tmp_path):
    values = agg.metric_attribute_values(tables.points(), window=None)
    points = tables.points().select("ts", "service", F.col("name").alias("metric"),
                                    F.explode("attrs").alias("attribute", "value"))
    assert points.count() == values.count()
    everything = points.unionByName(_with_closing_row(points))
    keys = ["service", "metric", "attribute"]
    src = _in_time_order(everything, str(tmp_path / "in"), ["2024-01-10", "2024-01-20", "2025-01-01"])
    got = run_available(stream_cardinality(src, keys, delay="1 hour"), str(tmp_path / "out"), "card", str(tmp_path / "cp"))
    want = (points.groupBy(F.window("ts", "1 hour")["start"].alias("window_start"), *keys)
            .agg(F.approx_count_distinct("value", 0.02).alias("cardinality")))
    cols = [*keys, "window_start", "cardinality"]
    assert rows(got, *cols) == rows(want, *cols)
    merged = agg.two_generation_max(got, keys)
    assert rows(merged, *cols) == rows(agg.two_generation_max(want, keys), *cols)
    # a row from before the watermark is dropped and counted
    old = points.orderBy("ts").limit(1)
    old.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = start_table(stream_cardinality(src, keys, delay="1 hour"), str(tmp_path / "out"), "card", str(tmp_path / "cp"))
    q.awaitTermination()
    assert late_rows(q) >= 1


def test_trace_health(tables, tmp_path):
    spans = tables.spans(times=True).select("trace_id", "span_id", "parent_span_id", "service", "ts")
    everything = spans.unionByName(_with_closing_row(spans, trace_id=-1))
    src = _in_time_order(everything, str(tmp_path / "in"), ["2025-01-01"])
    start_trace_health(src, str(tmp_path / "out"), str(tmp_path / "cp"), window="30 days", delay="1 day").awaitTermination()
    got = read_trace_health(tables.spark, str(tmp_path / "out"))
    want = traces.trace_health(spans, window="30 days")
    cols = ["service", "window_start", "traces", "orphan_ratio", "missing_root_ratio"]
    assert rows(got, *cols) == rows(want, *cols)


def test_traces_over_a_border_are_judged_once_in_the_window_of_their_first_span(spark, tmp_path):
    """Spans of the same traces before and after a border, in both orders, over restarts: the stream equals the batch."""
    minute = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    ddl = "trace_id string, span_id string, parent_span_id string, service string, ts string"
    batches = [
        [("a", "1", None, "web", minute(55)), ("b", "2", "1", "db", minute(58)), ("c", "1", None, "web", minute(10))],
        [("a", "2", "1", "db", minute(62)), ("b", "1", None, "web", minute(61)), ("c", "2", "9", "db", minute(50)), ("d", "1", "0", "db", minute(65)), ("d", "1", "0", "db", minute(65))],
        [("a", "3", "7", "web", minute(66)), ("e", "1", None, "web", minute(130)), ("e", "2", "1", "web", minute(121))],
        [("z", "1", None, "web", minute(600))]]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "cp"))
    frame = lambda rows_: spark.createDataFrame(rows_, ddl).withColumn("ts", F.col("ts").cast("timestamp"))
    for batch in batches:
        frame(batch).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame(batch).schema).parquet(source)
        start_trace_health(stream, out, state, window="1 hour", delay="10 minutes", patience_s=900).awaitTermination()
    spans = frame([r for b in batches for r in b])
    want = traces.trace_health(spans.where("trace_id <> 'z'"), window="1 hour")
    cols = ["service", "window_start", "traces", "orphan_ratio", "missing_root_ratio"]
    assert rows(read_trace_health(spark, out), *cols) == rows(want, *cols)
    assert want.agg(F.count_distinct("window_start")).first()[0] == 3


def test_trace_state_is_called_for_groups_not_for_traces(spark, tmp_path, monkeypatch):
    """Thousands of open traces are a few rows of state; closed, they equal the batch, with null ids and services, texts to escape and far times."""
    from obsgauge.streaming import tracestate

    monkeypatch.setattr(tracestate, "GROUPS", 16, raising=False)
    n = F.col("id")
    trace = F.when(n % 5000 > 0, (n % 5000).cast("string"))
    start = F.when(n % 5000 == 7, "9999-12-01").when(n % 5000 == 8, "0001-03-01").otherwise("2024-01-01").cast("timestamp")
    spans = spark.range(20000).select(
        trace.alias("trace_id"), F.when(n % 13 > 0, n % 11).alias("span_id"), F.when(n % 3 > 0, n % 7).alias("parent_span_id"),
        F.when(n % 4 > 0, F.concat(F.lit('a"\\[,\n\u00fc'), n % 4)).alias("service"), (start + F.make_dt_interval(secs=n % 5 * 7000.000001)).alias("ts"))
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "cp"))

    def run(df):
        df.write.mode("append").parquet(source)
        q = start_trace_health(spark.readStream.schema(spans.schema).parquet(source), out, state, window="30 days", delay="1 day")
        q.awaitTermination()
        return q.lastProgress["stateOperators"][0]

    open_ = spans.where(F.year("ts") < 9999)
    assert run(open_)["numRowsTotal"] <= 16 * 8
    run(open_.limit(1).withColumns({"trace_id": F.lit("z"), "ts": F.lit("2100-01-01").cast("timestamp")}))
    cols = ["service", "window_start", "traces", "orphan_ratio", "missing_root_ratio"]
    known = open_.fillna({"trace_id": "none"}).withColumn("span_id", F.col("span_id").cast("string")).withColumn("parent_span_id", F.col("parent_span_id").cast("string"))
    assert rows(read_trace_health(spark, out), *cols) == rows(traces.trace_health(known, window="30 days"), *cols)
    assert run(spans.where(F.year("ts") == 9999))["numRowsTotal"] <= 16 * 8  # held, for its window is open


def test_spans_behind_the_watermark_do_not_begin_a_trace_again(spark, tmp_path):
    ddl = "trace_id string, span_id string, parent_span_id string, service string, ts string"
    source, out, state = (str(tmp_path / k) for k in ("in", "out", "cp"))
    for row in (("a", "1", None, "web", "2024-01-01 00:10:00"), ("z", "1", None, "web", "2024-01-01 10:00:00"), ("a", "2", "1", "web", "2024-01-01 00:20:00"),
                ("z", "2", "1", "web", "2024-01-01 20:00:00")):
        df = spark.createDataFrame([row], ddl).withColumn("ts", F.col("ts").cast("timestamp"))
        df.write.mode("append").parquet(source)
        q = start_trace_health(spark.readStream.schema(df.schema).parquet(source), out, state)
        q.awaitTermination()
        if row[:2] == ("a", "2"):
            assert late_rows(q) == 1
    assert [tuple(r) for r in read_trace_health(spark, out).select("service", "traces").collect()] == [("web", 1)]


def test_one_group_holds_traces_that_are_due_and_traces_that_are_not(spark, tmp_path, monkeypatch):
    from obsgauge.streaming import tracestate

    monkeypatch.setattr(tracestate, "GROUPS", 1, raising=False)
    monkeypatch.setattr(tracestate, "PIECE", 2, raising=False)
    test_traces_over_a_border_are_judged_once_in_the_window_of_their_first_span(spark, tmp_path)


def test_alert_state(tables, tmp_path):
    spark = tables.spark
    grid = history.hourly(tables)
    samples = tables.samples()
    alerts = [history.HIGH_ERR, history.HIGH_ERR_NOW]
    from obsgauge.operators.series import windowed_ratio

    ratios = windowed_ratio(samples, grid, ["service"], "errors_total", "requests_total", [3 * 3600])
    hits = replay.true_steps(ratios, alerts, ["service"], grid).withColumnRenamed("service", "series")
    # every (rule, series) is evaluated at every step
    pairs = hits.select("rule", "series", "for_steps").distinct()
    steps = (pairs.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(grid.points - 1))))
             .withColumn("position", F.col("position").cast("bigint"))
             .join(hits.withColumn("_hit", F.lit(True)), ["rule", "series", "for_steps", "position"], "left")
             .select("rule", "series", "for_steps", "position", F.coalesce("_hit", F.lit(False)).alias("active")))
    path = str(tmp_path / "in")
    for lo, hi in ((0, 250), (250, 251), (251, grid.points)):
        steps.where((F.col("position") >= lo) & (F.col("position") < hi)).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(path)
    events = run_available(alert_events(src), str(tmp_path / "out"), "alerts", str(tmp_path / "cp"))
    got = firings_from_events(events)
    whole = spark.createDataFrame([(0, grid.points - 1)], "first_pos bigint, last_pos bigint")
    want = replay.replay(hits, whole, ["series"], grid)
    assert got.count() > 10
    assert rows(got.select("rule", "series", grid.time(F.col("active_pos")), grid.time(F.col("fired_pos")),
                           grid.time(F.col("resolved_pos")))) == rows(
        want.select("rule", "series", "active_at", "fired_at", "resolved_at"))


def test_export_gauges(tables, tmp_path):
    from obsgauge.plans.flows import Scoring
    from obsgauge.operators import scoring

    logs, points = tables.logs(), tables.points()
    s_logs, _ = _stored(logs, str(tmp_path / "logs"))
    s_points, _ = _stored(points, str(tmp_path / "points"))
    rules = [*ITEM_RULES, rule("EXT-MET-001")]
    q = export_gauges({"log": s_logs, "metric": s_points}, rules, str(tmp_path / "gauges"), every=None,
                      aggregates=lambda _s: {"exemplar_coverage": agg.exemplar_coverage(points)},
                      checkpoint=str(tmp_path / "cp"))
    q.awaitTermination()
    s = Scoring(tables.spark, {"log": logs, "metric": points}, rules)
    shown = ["gauge", "service", "impact", F.round("value", 9)]
    assert rows(read_gauges(tables.spark, str(tmp_path / "gauges")), *shown) == rows(
        scoring.score_gauges(s.scores, s.findings), *shown)


def test_trace_judge_needs_neither_the_package_on_a_worker_nor_a_prepared_session(tables):
    """The worker beside the driver has not the driver's sys.path, and sessions built elsewhere have another state store."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from obsgauge.session import ROCKSDB, STATE_STORE
    from obsgauge.streaming.tracestate import TraceJudge, stream_trace_verdicts

    alone = "import sys, pickle; sys.path = [p for p in sys.path if 'repo' not in p]; pickle.loads(sys.stdin.buffer.read()); assert 'obsgauge' not in sys.modules"
    done = subprocess.run([sys.executable, "-c", alone], input=cloudpickle.dumps(TraceJudge(1)), cwd="/", env={"PATH": "/usr/bin"}, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
    spark, before = tables.spark, tables.spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream_trace_verdicts(spark.readStream.format("rate").load().selectExpr(
        "value as trace_id", "value as span_id", "value as parent_span_id", "'a' as service", "timestamp as ts"))
    assert spark.conf.get(STATE_STORE) == ROCKSDB == before
