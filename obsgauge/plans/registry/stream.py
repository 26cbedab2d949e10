"""Registered queries that run a stream over everything available and read its table back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgauge.operators import aggregates as agg
from obsgauge.operators import replay, series
from obsgauge.plans.catalogue import ITEM_RULES
from obsgauge.plans.registry.base import TS, VIEWS, query
from obsgauge.plans.registry.intake import _message, _resource
from obsgauge.plans.registry.history import HIGH_ERR, HIGH_ERR_NOW, HOUR, hourly
from obsgauge.plans.registry.score import _ITEM_SQL, _SCORE
from obsgauge.sources.shared import shared_folder
from obsgauge.sources.tables import Tables
from obsgauge.streaming import (
    alert_events,
    export_gauges,
    firings_from_events,
    read_gauges,
    read_items,
    read_late,
    read_refused,
    read_trace_health,
    run_available,
    start_otlp_intake,
    start_trace_health,
    start_with_late_table,
    stream_cardinality,
    stream_cardinality_sketches,
    stream_rule_rollup,
)


class StreamTables(Tables):
    """The same projections over a file stream of a table."""

    def read(self, name: str) -> DataFrame:
        schema = super().read(name).schema
        return (self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                .parquet(self.folder))


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it goes with the application."""
    return shared_folder(spark, "obsgauge")


VIEWS["v_stream_verdicts"] = "\nunion all ".join(
    f"select '{rid}' as rule_id, service, ({cond}) as passed from {src}"
    for rid, (src, cond) in {
        **{(r + s): (f"(select *, null as ver from {v})", _ITEM_SQL[r][1])
           for r in ("RES-005", "EXT-RES-001", "EXT-RES-002", "EXT-RES-003")
           for s, v in (("", "v_logs"), (" ", "v_metric_points"))},
        **{f"{r}  ": ("(select *, service_version as ver from v_spans)", _ITEM_SQL[r][1])
           for r in ("RES-005", "EXT-RES-001", "EXT-RES-002", "EXT-RES-003")},
        **{r: _ITEM_SQL[r] for r in ("SPA-004", "LOG-001", "LOG-002", "EXT-LOG-001", "MET-002", "MET-005", "EXT-MET-002")},
    }.items())


@query("stream_rule_rollup", """
select service, trim(rule_id) as rule_id, count(*) as observed, sum(case when passed then 0 else 1 end)::bigint as violations,
       0::bigint as eval_errors
from v_stream_verdicts group by service, trim(rule_id)""")
def rule_rollup(t: Tables) -> DataFrame:
    s, work = StreamTables(t.spark, t.folder), work_folder(t.spark)
    rollup = stream_rule_rollup({"span": s.spans(), "log": s.logs(), "metric": s.points()}, ITEM_RULES)

    def store(df: DataFrame, _batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{work}/rollup")

    (rollup.writeStream.outputMode("complete").foreachBatch(store).trigger(availableNow=True)
     .option("checkpointLocation", f"{work}/state").start().awaitTermination())
    return t.spark.read.schema(rollup.schema).parquet(f"{work}/rollup")


@query("stream_cardinality", f"""
select service, name as metric, 'k' as attribute, strftime(date_trunc('day', ts), {TS}) as window_start,
       count(distinct attr_k) as exact, true as close
from v_metric_points
where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from v_metric_points)
group by service, name, date_trunc('day', ts)""")
def cardinality(t: Tables) -> DataFrame:
    """Closed windows: the exact count beside the streamed estimate, which must lie within 5 % and one (two of few values may share a register)."""
    s, work = StreamTables(t.spark, t.folder), work_folder(t.spark)
    points = s.points()
    values = points.select("ts", "service", F.col("name").alias("metric"), F.explode("attrs").alias("attribute", "value"))
    keys = ["service", "metric", "attribute", "window_start"]
    out = run_available(stream_cardinality(values, keys[:3], window="1 day", delay="1 hour"), f"{work}/table", "cardinality", f"{work}/state")
    exact = agg.metric_attribute_cardinality(t.points(), window="1 day").select(*keys, F.col("cardinality").alias("exact"))
    return out.join(exact, keys).select(*keys, "exact", (F.abs(F.col("cardinality") - F.col("exact")) <= 1 + 0.05 * F.col("exact")).alias("close"))


@query("stream_trace_health", f"""
select service, strftime(make_timestamp(w * 2592000 * 1000000), {TS}) as window_start, count(*) as traces,
       round(sum(case when dangling then 1 else 0 end) / count(*)::double, 6) as orphan_ratio,
       round(sum(case when rootless and (dangling or not broken) then 1 else 0 end) / count(*)::double, 6) as missing_root_ratio
from v_trace_service join v_trace_flags using (trace_id)
join (select trace_id, epoch(min(ts))::bigint // 2592000 as w from v_spans group by trace_id) m using (trace_id)
where (w + 1) * 2592000 <= (select epoch(max(ts)) - 86400 from v_spans)
group by service, w""")
def trace_health(t: Tables) -> DataFrame:
    work = work_folder(t.spark)
    spans = t.spans(times=True).select("trace_id", "span_id", "parent_span_id", "service", "ts")
    spans.write.parquet(f"{work}/spans")  # the normalised table a collector would append to
    stream = t.spark.readStream.schema(spans.schema).parquet(f"{work}/spans")
    start_trace_health(stream, f"{work}/counts", f"{work}/state", window="30 days", delay="1 day").awaitTermination()
    return read_trace_health(t.spark, f"{work}/counts")


VIEWS["v_unsegmented"] = """
select rule, service, a as active_pos, a + for_steps as fired_pos, case when b < (select last from v_hour_range) then b + 1 end as resolved_pos
from (select rule, service, for_steps, min(position) as a, max(position) as b
      from (select *, position - row_number() over (partition by rule, service order by position) as grp
            from v_true_steps where rule in ('HighErr', 'HighErrNow')) x group by rule, service, for_steps, grp) y
where b - a >= for_steps"""


@query("stream_alert_state", "select rule, service as series, active_pos, fired_pos, resolved_pos from v_unsegmented")
def alert_state(t: Tables) -> DataFrame:
    work, longest, grid = work_folder(t.spark), 3 * HOUR, hourly(t)
    ratios = series.windowed_ratio(t.samples(), grid, ["service"], "errors_total", "requests_total", [longest])
    hits = replay.true_steps(ratios, [HIGH_ERR, HIGH_ERR_NOW], ["service"], grid).withColumnRenamed("service", "series")
    # A true step, and a quiet one right after each run of true steps: all a series' state can react to.
    after = hits.withColumn("position", F.col("position") + 1).where(F.col("position") < grid.points)
    steps = (hits.withColumn("active", F.lit(True)).unionByName(after.withColumn("active", F.lit(False)))
             .groupBy("rule", "series", "for_steps", "position").agg(F.max("active").alias("active")))
    steps.write.parquet(f"{work}/steps")
    stream = t.spark.readStream.schema(steps.schema).parquet(f"{work}/steps")
    events = run_available(alert_events(stream), f"{work}/events", "alerts", f"{work}/state")
    return firings_from_events(events)




@query("stream_dead_letters", """
select 'item' as kind, service as subject, count(*) as n, sum(body_len)::bigint as bytes from v_logs where event_id % 50 > 2 group by service
union all select 'refused', case event_id % 50 when 2 then 'no payload' else 'malformed' end, count(*), null from v_logs where event_id % 50 <= 2 group by 2""")
def dead_letters(t: Tables) -> DataFrame:
    """Payload texts of all log records in several files, some cut, some no JSON, some of another kind; the stream is started again after each file."""
    work = work_folder(t.spark)
    logs = t.logs()
    record = F.struct("severity_number", F.struct(F.repeat(F.lit("x"), F.col("body_len")).alias("stringValue")).alias("body"))
    good = _message("log", _resource(logs), record)
    bad = F.col("event_id") % 50
    text = (F.when(bad == 0, F.expr("substring(value, 1, length(value) div 2)")).when(bad == 1, F.lit("connection reset by peer"))
            .when(bad == 2, F.lit('{"resourceSpans": []}')).otherwise(F.col("value")))
    texts = logs.select("event_id", good).withColumn("value", text)
    for part in range(3):
        texts.where(F.col("event_id") % 3 == part).select("value").write.mode("append").text(f"{work}/payloads")
        start_otlp_intake(t.spark, "log", f"{work}/payloads", f"{work}/items", f"{work}/refused", f"{work}/state").awaitTermination()
    items = read_items(t.spark, "log", f"{work}/items").groupBy(F.lit("item").alias("kind"), F.col("service").alias("subject")).agg(
        F.count("*").alias("n"), F.sum("body_len").cast("bigint").alias("bytes"))
    refused = read_refused(t.spark, f"{work}/refused").groupBy(F.lit("refused").alias("kind"), F.col("reason").alias("subject")).agg(
        F.count("*").alias("n"), F.lit(None).cast("bigint").alias("bytes"))
    return items.unionByName(refused)


_ITEM_IDS = ", ".join(f"'{r.rule_id}'" for r in ITEM_RULES)
VIEWS["v_item_results"] = f"select * from v_results where rule_id in ({_ITEM_IDS})"
VIEWS["v_item_scores"] = f"select service, {_SCORE.format(c="source = 'spec'", d='100.0')}::double as spec_score from v_item_results group by service"


@query("published_gauges", """
select 'service_score' as gauge, service, null::varchar as impact, round(spec_score, 6) as value from v_item_scores
union all select 'fleet_score', null, null, round(avg(spec_score), 6) from v_item_scores
union all select 'findings', service, impact, count(*)::double from v_item_results where not passed group by service, impact""")
def published_gauges(t: Tables) -> DataFrame:
    """The version that the gauge stream over all signals published last."""
    s, work = StreamTables(t.spark, t.folder), work_folder(t.spark)
    export_gauges({"span": s.spans(), "log": s.logs(), "metric": s.points()}, ITEM_RULES, f"{work}/versions", checkpoint=f"{work}/state",
                  every=None).awaitTermination()
    return read_gauges(t.spark, f"{work}/versions")


@query("late_row_table", f"""
select e.event_id % 4 as tick, service, count(*) as late, strftime(max(w.mark) - interval 10 day, {TS}) as watermark,
       round(max(date_diff('microsecond', e.ts, w.mark - interval 10 day)) / 1e6, 6) as most_late_by_s
from v_logs e
join (select k, max(l.ts) as mark from (values (1), (2), (3)) as ticks(k) join v_logs l on l.event_id % 4 < k group by k) w on e.event_id % 4 = w.k
where e.ts < w.mark - interval 10 day
group by 1, 2""")
def late_row_table(t: Tables) -> DataFrame:
    """Records that arrive in four ticks, each after a restart; what lies ten days behind the ticks before is late."""
    work = work_folder(t.spark)
    logs = t.logs().select("event_id", "service", "ts")
    for tick in range(4):
        logs.where(F.col("event_id") % 4 == tick).write.mode("append").parquet(f"{work}/arrived")
        stream = t.spark.readStream.schema(logs.schema).parquet(f"{work}/arrived")
        start_with_late_table(stream, f"{work}/dealt", f"{work}/state", 10 * 86400).awaitTermination()
    late = read_late(t.spark, f"{work}/dealt", logs)
    return late.groupBy((F.col("event_id") % 4).alias("tick"), "service").agg(
        F.count("*").alias("late"), F.max("watermark").alias("watermark"), F.max("late_by_s").alias("most_late_by_s"))


VIEWS["v_two_days"] = """
select service, name as metric, d, attr_k, d + to_days(late) as w
from (select *, date_trunc('day', ts) as d from v_metric_points) p, (values (0), (1)) as g(late)
where d + interval 1 day <= (select max(ts) - interval 1 hour from v_metric_points)"""


@query("stream_two_generations", f"""
select service, metric, 'k' as attribute, strftime(w, {TS}) as window_start, max(n) as larger, any_value(n_both) as together, true as close
from (select service, metric, w, d, count(distinct attr_k) as n from v_two_days group by 1, 2, 3, 4) o
join (select service, metric, w, count(distinct attr_k) as n_both from v_two_days group by 1, 2, 3) b using (service, metric, w)
group by service, metric, w""")
def two_generations(t: Tables) -> DataFrame:
    """Stored sketches of closed days, merged pairwise: within 5 % and one of the exact counts beside them."""
    s, work = StreamTables(t.spark, t.folder), work_folder(t.spark)
    keys = ["service", "metric", "attribute"]
    pick = lambda df: df.select("ts", "service", F.col("name").alias("metric"), F.explode("attrs").alias("attribute", "value"))
    stored = run_available(stream_cardinality_sketches(pick(s.points()), keys, window="1 day", delay="1 hour"), f"{work}/table", "sketches", f"{work}/state")
    merged = agg.two_generations(stored, keys, 86400)
    days = pick(t.points()).withColumn("window_start", F.date_trunc("day", "ts"))
    days = days.join(stored.select(*keys, "window_start"), [*keys, "window_start"], "left_semi")
    per_day = days.groupBy(*keys, "window_start").agg(F.count_distinct("value").alias("larger"))
    both = days.withColumn("window_start", F.explode(F.array("window_start", F.col("window_start") + F.expr("interval 1 day"))))
    exact = agg.two_generation_max(per_day, keys, 86400, "larger").join(
        both.groupBy(*keys, "window_start").agg(F.count_distinct("value").alias("n_together")), [*keys, "window_start"])
    near = lambda estimate, n: F.abs(F.col(estimate) - F.col(n)) <= 1 + 0.05 * F.col(n)
    return merged.join(exact, [*keys, "window_start"]).select(
        *keys, "window_start", "larger", F.col("n_together").alias("together"), (near("cardinality", "larger") & near("together", "n_together")).alias("close"))
