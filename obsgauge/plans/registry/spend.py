"""Registered queries: usage, pricing, storage, lifecycle, movement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.operators import spend
from obsgauge.plans.registry.base import TS, VIEWS, query
from obsgauge.sources import backend, snapshots
from obsgauge.sources.tables import Tables

WEEK_S = 7 * 86400
RATES = spend.Rates(per_gb=0.61, per_million_series=9.5, per_gb_by_signal={"logs": 0.27, "metrics": 0.42},
                    storage_gb_month={"STANDARD": 0.031, "STANDARD_IA": 0.017, "GLACIER_IR": 0.006, "GLACIER": 0.005})

VIEWS["v_class_bytes"] = """
select case when storage_class = '' then 'STANDARD' else storage_class end as storage_class, sum(bytes)::bigint as bytes
from v_storage group by 1"""
VIEWS["v_rates_class"] = """
select * from (values ('STANDARD', 0.031::double), ('STANDARD_IA', 0.017::double), ('GLACIER_IR', 0.006::double),
  ('GLACIER', 0.005::double)) as t(cls, rate)"""
_LINE = """
select service, team, signal, b / 1e9::double * (case signal when 'logs' then 0.27 when 'metrics' then 0.42 else 0.61 end)::double * (730.0 / {hours})::double as ingest_monthly,
       s / 1e6::double * 9.5::double as active_series_monthly
from (select service, {team} as team, signal, sum({bytes})::bigint as b, sum(active_series)::bigint as s from v_usage group by 1, 2, 3) u"""
VIEWS["v_lines"] = _LINE.format(hours="168.0", team="team", bytes="ingest_bytes")
VIEWS["v_prev_lines"] = _LINE.format(hours="168.0", team="case when team = 'de' then 'legacy' else team end",
                                     bytes="ingest_bytes - ingest_bytes // 10")
VIEWS["v_priced_storage"] = """
select storage_class, bytes / 1e9::double as gb, bytes / 1e9::double * coalesce(rate, 0) as monthly
from v_class_bytes left join v_rates_class on cls = storage_class"""


def lines(t: Tables) -> DataFrame:
    return spend.price_lines(spend.gather_usage(streams=t.usage()), RATES, WEEK_S)


def previous_lines(t: Tables) -> DataFrame:
    """The report before: a tenth less ingest, and one team under its former name."""
    earlier = (t.usage()
               .withColumn("ingest_bytes", F.col("ingest_bytes") - F.expr("ingest_bytes div 10"))
               .withColumn("team", F.when(F.col("team") == "de", "legacy").otherwise(F.col("team"))))
    return spend.price_lines(spend.gather_usage(streams=earlier), RATES, WEEK_S)


def storage(t: Tables) -> DataFrame:
    return spend.price_storage(backend.storage_by_class(t.objects()), RATES)


@query("storage_by_class", "select storage_class, bytes from v_class_bytes")
def storage_by_class(t: Tables) -> DataFrame:
    return backend.storage_by_class(t.objects())


@query("gather_usage", """
select service, team, signal, sum(b)::bigint as ingest_bytes, sum(s)::bigint as active_series from (
  select service, team, signal, ingest_bytes as b, active_series as s from v_usage
  union all select service, '', 'metrics', 0, count(distinct name || '/' || attr_k) from v_metric_points group by service
  union all select service, '', 'logs', sum(body_len), 0 from v_logs group by service) x
group by service, team, signal""")
def gather_usage(t: Tables) -> DataFrame:
    usage = spend.gather_usage(
        series=backend.active_series_by_service(t.backend_samples()),
        log_bytes=backend.log_bytes_by_service(t.logs(), "2024-01-31 00:00:00", 31 * 86400),
        streams=t.usage())
    return usage.groupBy("service", "team", "signal").agg(
        F.sum("ingest_bytes").alias("ingest_bytes"), F.sum("active_series").alias("active_series"))


@query("price_lines", """
select service, team, signal, round(ingest_monthly, 8) as ingest_monthly,
       round(active_series_monthly, 8) as active_series_monthly,
       round(ingest_monthly + active_series_monthly, 8) as total_monthly from v_lines""", digits=8)
def price_lines(t: Tables) -> DataFrame:
    return lines(t)


@query("price_storage", "select storage_class, round(gb, 6) as gb, round(monthly, 6) as monthly from v_priced_storage")
def price_storage(t: Tables) -> DataFrame:
    return storage(t)


@query("total_monthly", """
select round((select sum(ingest_monthly + active_series_monthly) from v_lines)
             + (select sum(monthly) from v_priced_storage), 4) as total_monthly""")
def total_monthly(t: Tables) -> DataFrame:
    return spend.total_monthly(lines(t), storage(t)).select(F.round("total_monthly", 4).alias("total_monthly"))


@query("budget_gate", """
select round((select sum(ingest_monthly + active_series_monthly) from v_lines)
             + (select sum(monthly) from v_priced_storage), 4) as total_monthly,
       (select sum(ingest_monthly + active_series_monthly) from v_lines) > 1000 as over_budget""")
def budget_gate(t: Tables) -> DataFrame:
    return spend.budget_gate(spend.total_monthly(lines(t), storage(t)), 1000.0).withColumn(
        "total_monthly", F.round("total_monthly", 4))


@query("lifecycle_savings", """
select s.storage_class as from_class, t.dst as to_class, round(bytes / 1e9, 6) as gb,
       round(bytes / 1e9 * f.rate, 6) as current_monthly, round(bytes / 1e9 * r.rate, 6) as projected_monthly,
       round(bytes / 1e9 * f.rate - bytes / 1e9 * r.rate, 6) as savings_monthly
from v_class_bytes s
join (values ('STANDARD', 'STANDARD_IA'), ('STANDARD', 'GLACIER_IR'), ('STANDARD', 'GLACIER'), ('STANDARD', 'DEEP_ARCHIVE'),
             ('STANDARD_IA', 'GLACIER_IR'), ('GLACIER_IR', 'GLACIER'), ('GLACIER', 'DEEP_ARCHIVE')) as t(src, dst)
  on t.src = s.storage_class
join v_rates_class f on f.cls = t.src join v_rates_class r on r.cls = t.dst
where r.rate < f.rate and bytes <> 0""")
def lifecycle_savings(t: Tables) -> DataFrame:
    return spend.lifecycle_savings(backend.storage_by_class(t.objects()), RATES)


@query("cost_trend", """
select service, team, signal, round(c, 8) as current, round(p, 8) as previous, round(c - p, 8) as delta,
       round(case when p > 0 then (c - p) / p * 100 else 0 end, 8) as percent_delta
from (select coalesce(a.service, b.service) as service, coalesce(a.team, b.team) as team, coalesce(a.signal, b.signal) as signal,
             coalesce(a.ingest_monthly + a.active_series_monthly, 0) as c,
             coalesce(b.ingest_monthly + b.active_series_monthly, 0) as p
      from v_lines a full join v_prev_lines b on a.service = b.service and a.team = b.team and a.signal = b.signal) x""", digits=8)
def cost_trend(t: Tables) -> DataFrame:
    return spend.cost_trend(lines(t), previous_lines(t))


@query("trend_total", """
select round((select sum(ingest_monthly + active_series_monthly) from v_lines)
             - (select sum(ingest_monthly + active_series_monthly) from v_prev_lines), 3) as total_delta""")
def trend_total(t: Tables) -> DataFrame:
    stored = storage(t)
    return spend.trend_total(spend.total_monthly(lines(t), stored), spend.total_monthly(previous_lines(t), stored)
                             ).select(F.round("total_delta", 3).alias("total_delta"))


@query("last_snapshot_before", f"""
select strftime(o_orderdate, {TS}) as taken_at, count(*) as lines, sum(floor(o_totalprice))::bigint as total
from orders where o_orderdate = (select max(o_orderdate) from orders where o_orderdate < timestamp '1998-01-01')
group by o_orderdate""")
def last_snapshot_before(t: Tables) -> DataFrame:
    return snapshots.last_snapshot_before(t.report_snapshots(), "1998-01-01 00:00:00")
