"""Registered queries over stored reports, and checks of what users hand in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge import schemas
from obsgauge.functions import attributes as attr
from obsgauge.operators import grading, judge, runhealth, scoring
from obsgauge.operators import spend as spend_ops
from obsgauge.plans.catalogue import DEFAULT_RULES, Rule, catalogue_frame
from obsgauge.plans.flows import Scoring, register_aggregate
from obsgauge.plans.flows import showback as run_showback
from obsgauge.plans.registry import spend
from obsgauge.plans.registry.base import TS, VIEWS, query
from obsgauge.plans.registry.history import _stats_sql
from obsgauge.plans.registry.intake import _message, _resource
from obsgauge.sources import snapshots
from obsgauge.sources.shared import shared_folder
from obsgauge.sources.otlp import otlp_from_messages
from obsgauge.sources.tables import Tables

_COST_TREND = """
select service, team, signal, round(c, 8) as current, round(p, 8) as previous, round(c - p, 8) as delta
from (select coalesce(a.service, b.service) as service, coalesce(a.team, b.team) as team, coalesce(a.signal, b.signal) as signal,
             coalesce(a.ingest_monthly + a.active_series_monthly, 0) as c, coalesce(b.ingest_monthly + b.active_series_monthly, 0) as p
      from v_lines a full join v_prev_lines b on a.service = b.service and a.team = b.team and a.signal = b.signal) x"""


@query("showback", _COST_TREND, digits=8)
def showback(t: Tables) -> DataFrame:
    """Two weekly reports through the stored history: the second is compared with what the first has left there."""
    path = shared_folder(t.spark, "cost-history")
    earlier = (t.usage().withColumn("ingest_bytes", F.col("ingest_bytes") - F.expr("ingest_bytes div 10"))
               .withColumn("team", F.when(F.col("team") == "de", "legacy").otherwise(F.col("team"))))
    for usage, taken_at in ((earlier, "2024-01-01 00:00:00"), (t.usage(), "2024-01-08 00:00:00")):
        out = run_showback(t.spark, spend_ops.gather_usage(streams=usage), t.objects(), spend.RATES, spend.WEEK_S, taken_at, path)
    return out.trend.drop("percent_delta")


@query("stored_scores", "select service, round(spec_score, 6) as spec_score, 'scores' as part from v_scores "
       "union all select service, round(ratio, 6), rule_id from v_results where not passed")
def stored_scores(t: Tables) -> DataFrame:
    """One scoring written to the history and its latest snapshot read back."""
    path = shared_folder(t.spark, "score-history")
    s = Scoring(t.spark, t.signals(names=True)).write_results()  # four tables are made of them
    snapshots.write_score_snapshot(path, s.scores, s.results, s.findings, scoring.fleet_score(s.scores), "2024-01-01 00:00:00")
    last = {name: snapshots.read_last_snapshot(t.spark, f"{path}/{name}", "2024-01-02 00:00:00")
            for name in ("service_scores", "findings")}
    return last["service_scores"].select("service", "spec_score", F.lit("scores").alias("part")).unionByName(
        last["findings"].select("service", F.col("ratio").alias("spec_score"), F.col("rule_id").alias("part")))


VIEWS["v_report_ratios"] = """
select 'report-' || strftime(date_trunc('day', ts), '%Y%m%d') as file, name as rule_id, service,
       sum(case when value > 100 then 1 else 0 end) / count(*)::double as ratio
from v_metric_points group by 1, 2, 3"""
VIEWS["v_report_stats"] = _stats_sql("v_report_ratios", "rule_id", "ratio")


@query("report_ratio_summary", """
select s.rule_id, n, coalesce(last_services, 0) as last_services, round(median, 6) as median, round(max, 6) as max
from v_report_stats s left join (
  select rule_id, count(*) as last_services from v_report_ratios where file = (select max(file) from v_report_ratios) group by rule_id) l
  on l.rule_id = s.rule_id""")
def report_ratio_summary(t: Tables) -> DataFrame:
    ratios = t.points().groupBy(F.concat(F.lit("report-"), F.date_format("ts", "yyyyMMdd")).alias("file"), F.col("name").alias("rule_id"), "service").agg(
        (F.count_if(F.col("value") > 100) / F.count(F.lit(1))).alias("ratio"))
    return runhealth.report_ratio_summary(ratios)


@query("rules_evaluated", """
select r.rule_id, count(v.service) as services from v_rules r left join v_results v on v.rule_id = r.rule_id group by r.rule_id""")
def rules_evaluated(t: Tables) -> DataFrame:
    return scoring.rules_evaluated(catalogue_frame(t.spark, DEFAULT_RULES), Scoring(t.spark, t.signals(names=True)).results)


VIEWS["v_claimed_incidents"] = """
select case when o_orderkey % 50 = 0 then ' ' when o_orderkey % 51 = 0 then null else 'inc-' || (o_orderkey // 2) end as incident,
       case when o_custkey % 40 = 0 then null else o_orderdate::timestamp end as start_ts,
       case when o_custkey % 31 = 0 then null else o_orderdate::timestamp + to_days((o_custkey % 9)::int - 1) end as end_ts
from orders"""


@query("incident_faults", f"""
select incident, strftime(start_ts, {TS}) as start_ts, strftime(end_ts, {TS}) as end_ts, fault from (
  select *, unnest([case when trim(coalesce(incident, '')) = '' then 'id' end, case when n > 1 and trim(incident) <> '' then 'repeated' end,
                    case when start_ts is null then 'start' end, case when end_ts is null then 'end' end,
                    case when end_ts <= start_ts then 'order' end]) as fault
  from (select *, count(*) over (partition by incident) as n from v_claimed_incidents) x) y where fault is not null""")
def incident_faults(t: Tables) -> DataFrame:
    key, customer, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    incidents = t.read("orders").select(
        F.when(key % 50 == 0, " ").when(key % 51 == 0, None).otherwise(F.concat(F.lit("inc-"), F.expr("o_orderkey div 2").cast("string"))).alias("incident"),
        F.when(customer % 40 != 0, day).alias("start_ts"),
        F.when(customer % 31 != 0, day + F.make_dt_interval((customer % 9 - 1).cast("int"))).alias("end_ts"))
    return judge.incident_faults(incidents)


register_aggregate("event_volume", lambda signals: signals["log"].groupBy("service").agg(F.count(F.lit(1)).alias("records")))
#: A user's own rule on an aggregate of their own.
QUIET = Rule("TEAM-1", "extension", "Not louder than agreed", "log", "low", "records < :most", aggregate="event_volume", params={"most": 700})


@query("own_aggregate", "select service, count(*) < 700 as passed, 1 as observed from v_logs group by service")
def own_aggregate(t: Tables) -> DataFrame:
    return Scoring(t.spark, {"log": t.logs()}, [QUIET]).results.select("service", "passed", "observed")


VIEWS["v_scenario_lines"] = """
select l_orderkey as id, 'f' || (l_suppkey % 3) as fault, 'Pod/shop/supp-' || l_suppkey as entity, l_linenumber % 4 <> 0 as usable
from lineitem"""


@query("scenario_truth", """
select 'sre-' || id as scenario, case when reason is null then 'shop' end as application, case when reason is null then faults end as category,
       case when reason is null then entities end as entities, reason
from (select o_orderkey as id, faults, entities,
             case when o_orderkey <= 0 then 'id' when o_custkey % 10 = 0 then 'category' when o_custkey % 11 = 0 then 'application' when entities is null then 'objects' end as reason
      from orders join (
        select id, string_agg(distinct fault, '+' order by fault) as faults,
               string_agg(distinct entity, ',' order by entity) filter (where usable) as entities
        from v_scenario_lines group by id) l on l.id = o_orderkey) x""")
def scenario_truth(t: Tables) -> DataFrame:
    """A scenario catalogue as JSON texts, one per order with its lines as injections; some not usable."""
    def injection(line):
        named = F.struct(F.struct(F.lit("Pod").alias("kind"), F.struct(
            F.concat(F.lit("supp-"), line["l_suppkey"].cast("string")).alias("name"), F.lit("shop").alias("namespace")).alias("metadata")).alias("kubernetesObject"))
        return F.struct(F.concat(F.lit("f"), (line["l_suppkey"] % 3).cast("string")).alias("id"), F.when(line["l_linenumber"] % 4 != 0, named).alias("args"))

    numbers = F.collect_list(F.struct("l_suppkey", "l_linenumber")).alias("lines")  # of one order
    lines = t.read("lineitem").groupBy("l_orderkey").agg(numbers).select("l_orderkey", F.transform("lines", injection).alias("injections"))
    orders = t.read("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    document = F.to_json(F.struct(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 10 == 0, "finops").otherwise("sre").alias("category"),
        F.struct(F.when(F.col("o_custkey") % 11 != 0, F.array(F.struct(F.lit("shop").alias("id")))).alias("applications")).alias("environment"),
        F.array(F.struct("injections")).alias("disruptions")))
    catalogue = orders.select(F.from_json(document, schemas.SCENARIO_CATALOGUE).alias("d")).select("d.*")
    text = F.transform("entities", lambda e: F.concat_ws("/", e["kind"], e["namespace"], e["name"]))
    return grading.judged_scenarios(catalogue).select("scenario", "application", "category", F.array_join(F.array_sort(text), ",").alias("entities"), "reason")


# --- files written and read back --------------------------------------------------------------

@query("read_last_snapshot", f"""
select strftime(o_orderdate::timestamp, {TS}) as taken_at, count(*) as lines from orders
where o_orderdate::timestamp = (select max(o_orderdate::timestamp) from orders where o_orderdate::timestamp < timestamp '1998-01-01' and o_orderdate % 5 = 0)
group by o_orderdate""".replace("o_orderdate % 5 = 0", "day(o_orderdate) % 5 = 0"))
def read_last_snapshot(t: Tables) -> DataFrame:
    """A history of every fifth day of the month, stored by day; only the last day before the instant is read."""
    path = shared_folder(t.spark, "history")
    daily = t.report_snapshots().where(F.dayofmonth("taken_at") % 5 == 0).withColumn("snapshot_date", F.to_date("taken_at"))
    daily.repartition("snapshot_date").write.partitionBy("snapshot_date").parquet(path)
    return snapshots.read_last_snapshot(t.spark, path, "1998-01-01 00:00:00").select("taken_at", "lines")


@query("saved_aggregates", """
select service, 'metric_attribute_cardinality' as aggregate, name as metric, 'k' as attribute, count(distinct attr_k)::double as cardinality, 2::bigint as n_dims
from v_metric_points group by service, name""")
def saved_aggregates(t: Tables) -> DataFrame:
    """Aggregates saved as JSON arrays, a file a service, and read back with dimensions and measures told apart."""
    path = shared_folder(t.spark, "aggregates")
    rows = t.points().groupBy("service", "name").agg(F.count_distinct(F.col("attrs")["k"]).alias("cardinality"))
    row = F.struct(F.col("service").alias("Service"), F.lit("metric_attribute_cardinality").alias("Aggregate"),
                   F.struct(F.col("name").alias("metric"), F.lit("k").alias("attribute"), "cardinality").alias("Fields"))
    files = rows.groupBy(F.xxhash64("service").alias("file")).agg(F.to_json(F.collect_list(row)).alias("value"))  # the metrics of one service
    files.write.partitionBy("file").text(path)
    back = snapshots.read_aggregate_snapshots(t.spark, f"{path}/file=*")
    return back.select("service", "aggregate", F.col("dims")["metric"].alias("metric"), F.col("dims")["attribute"].alias("attribute"),
                       F.col("fields")["cardinality"].alias("cardinality"), F.size("dims").alias("n_dims"))


@query("saved_reports", """
select strftime(strptime(file, 'report-%Y%m%d'), '%Y-%m-%d') as day, rule_id, service, round(ratio, 6) as ratio, null as reason from v_report_ratios
union all select 'broken', null, null, null, 'malformed' union all select 'empty', null, null, null, 'no snapshot'""")
def saved_reports(t: Tables) -> DataFrame:
    """Daily reports as JSON files, one of them cut off and one without a snapshot, read back as ratios and refusals."""
    path = shared_folder(t.spark, "reports")
    found = t.points().groupBy(F.to_date("ts").cast("string").alias("day"), "service", F.col("name").alias("rule_id")).agg(
        (F.count_if(F.col("value") > 100) / F.count(F.lit(1))).alias("ratio"))
    services = found.groupBy("day", "service").agg(F.collect_list(F.struct("rule_id", F.struct("ratio").alias("stats"))).alias("findings"))
    days = services.groupBy("day").agg(F.collect_list(F.struct("service", "findings")).alias("services"))  # the rules and services of a day
    texts = days.select("day", F.to_json(F.struct(F.col("day").alias("window"), F.struct("services").alias("snapshot"))).alias("value"))
    odd = t.spark.range(1).select(F.inline(F.array(F.struct(F.lit("broken").alias("day"), F.lit('{"snapshot": {').alias("value")),
                                                   F.struct(F.lit("empty").alias("day"), F.lit('{"window": "x"}').alias("value")))))
    texts.unionByName(odd).write.partitionBy("day").text(path)
    day = F.regexp_extract("file", r"day=([^/]+)/", 1).alias("day")
    ratios = snapshots.read_report_ratios(t.spark, f"{path}/day=*")
    refused = snapshots.unreadable_reports(t.spark, f"{path}/day=*")
    return ratios.select(day, "rule_id", "service", "ratio").unionByName(refused.select(day, "reason"), allowMissingColumns=True)


@query("soak_samples", f"""
select 'soak' as run, strftime(date_trunc('minute', ts), {TS}) as ts, case when event_id % 9 = 0 then 0 else value end::double as rss,
       (event_id % 100)::double as pairs, 0::double as evictions, (event_id % 7 + event_id % 5 + event_id % 3)::double as items from events""")
def soak_samples(t: Tables) -> DataFrame:
    """Run samples through CSV, every ninth memory reading unreadable, columns in another order and one more."""
    path = f"{shared_folder(t.spark, 'soak')}/soak.csv"
    e, key = t.read("events"), F.col("event_id")
    e.select(F.lit("x").alias("other"), F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
             (key % 7).alias("items_traces"), (key % 5).alias("items_metrics"), (key % 3).alias("items_logs"), F.lit("").alias("evictions_total"),
             F.when(key % 9 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("rss_bytes"), (key % 100).alias("pairs_tracked")
             ).write.option("header", True).csv(path)
    return snapshots.read_soak_metrics(t.spark, path, run="soak")


@query("truncated_texts", """
select doc_id, left(text, list_max(list_filter(range(0, 257), lambda i: strlen(left(text, i)) <= 256))) as shown from documents""")
def truncated_texts(t: Tables) -> DataFrame:
    """Texts cut for a display of 256 bytes, never inside a character."""
    return t.read("documents").select("doc_id", attr.truncate_attr(F.col("text"), 256).alias("shown"))


@query("typed_attribute_values", """
select event_id::varchar as id, regexp_replace(cast(round(value, 2) as varchar), '\\.0$', '') as as_double, case when user_id % 2 = 0 then 'true' else 'false' end as as_bool,
       user_id::varchar as as_int, base64(event_type::blob) as as_bytes, '' as as_nothing from events""".replace("\\\\", "\\"))
def typed_attribute_values(t: Tables) -> DataFrame:
    """Attributes of every value type through a payload and back as texts."""
    e = t.read("events").withColumn("resource", F.create_map(F.lit("service.name"), F.lit("shop"), F.lit("deployment.environment.name"), F.lit("x")))

    def kv(key: str, field: str | None = None, value=None):
        inner = F.struct(value.alias(field)) if field else F.struct(F.lit(None).cast("string").alias("stringValue"))
        return F.to_json(F.struct(F.lit(key).alias("key"), inner.alias("value")))

    parts = [kv("d", "doubleValue", F.round("value", 2)), kv("b", "boolValue", F.col("user_id") % 2 == 0), kv("i", "intValue", F.col("user_id").cast("string")),
             kv("y", "bytesValue", F.base64(F.col("event_type").cast("binary"))), kv("n"), kv("id", "stringValue", F.col("event_id").cast("string"))]
    attributes = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    text = F.regexp_replace(_message("log", _resource(e), F.struct(F.lit("@").alias("attributes"))), '"@"', "@")
    got = otlp_from_messages(e.select(F.replace(text, F.lit("@"), attributes).alias("value")), "log")
    return got.select(*[F.col("attrs")[k].alias(n) for k, n in (("id", "id"), ("d", "as_double"), ("b", "as_bool"), ("i", "as_int"), ("y", "as_bytes"), ("n", "as_nothing"))])
