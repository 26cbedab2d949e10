"""Registration, output normalisation and the shared table expressions of the SQL side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsgauge.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Counts as bigint, doubles to a few digits, times as text: what both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function of ``Tables`` as a query, with its SQL twin if there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: comparable(fn(Tables(spark, folder)), digits)
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register


#: name → SQL of a common table expression; may use the ones above it.
VIEWS: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The statement behind the table expressions it needs."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for v in set(re.findall(r"\bv_\w+", text)):
            if v in VIEWS and v not in needed:
                needed.add(v)
                visit(VIEWS[v])

    visit(sql)
    ctes = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in VIEWS if v in needed)
    return f"with {ctes}\n{sql.strip()}" if ctes else sql.strip()


TS = "'%Y-%m-%d %H:%M:%S'"

VIEWS["v_svc"] = """
select n as b,
       case when n = 7 then null when n = 6 then 'unknown_service:java' else concat('svc-', cast(n as varchar)) end as res_service_name,
       case when n = 7 then '<unknown>' when n = 6 then 'unknown_service:java' else concat('svc-', cast(n as varchar)) end as service,
       case when n <= 2 then 'production' when n <= 5 then 'staging' end as env
from (values (0),(1),(2),(3),(4),(5),(6),(7)) as t(n)"""
VIEWS["v_spans"] = """
select l.trace_id, l.span_id, l.parent_span_id, concat_ws('-', l.trace_id, l.span_id, l.pk, l.sk) as span_item, s.service, s.res_service_name, s.env,
       concat('v', cast(l.span_id % (l.b + 1) as varchar)) as service_version,
       p.p_name as name,
       case l.rf when 'R' then 'client' when 'A' then 'server' else 'internal' end as kind,
       case l.ls when 'F' then 'error' else 'ok' end as status, l.ts
from (select l_orderkey as trace_id, l_linenumber as span_id,
             case when l_linenumber > 1 then l_linenumber - 1 end as parent_span_id,
             l_suppkey % 8 as b, l_suppkey as sk, l_partkey as pk, l_returnflag as rf, l_linestatus as ls, o_orderdate as ts
      from lineitem join orders on o_orderkey = l_orderkey) l
join v_svc s on s.b = l.b
join part p on p.p_partkey = l.pk"""
VIEWS["v_logs"] = """
select e.event_id, e.ts, s.service, s.res_service_name, s.env,
       case e.event_type when 'view' then 9 when 'error' then 17 when 'click' then 5 when 'purchase' then 13 else 0 end as severity,
       case e.event_type when 'click' then 'debug' when 'purchase' then 'WARNING' else '' end as severity_text,
       (cast(regexp_extract(e.props, '[0-9]+', 0) as int) % 8) >= (e.user_id % 8) as has_trace_id,
       length(e.props) as body_len
from events e join v_svc s on s.b = e.user_id % 8"""
VIEWS["v_metric_points"] = """
select e.event_id, e.ts, s.service, s.res_service_name, s.env,
       case e.event_type when 'click' then 'http.requests' when 'view' then 'page.view.seconds'
            when 'purchase' then 'purchase_bytes_total' when 'error' then 'errors' else 'request.duration' end as name,
       case e.event_type when 'signup' then 'histogram' when 'view' then 'gauge' else 'sum' end as type,
       case e.event_type when 'error' then '' when 'view' then 's' else '1' end as unit,
       regexp_extract(e.props, '[0-9]+', 0) as attr_k,
       case when e.event_type = 'signup' then cast(regexp_extract(e.props, '[0-9]+', 0) as int) % 3 end as bounds_id,
       case when e.event_type = 'signup' and e.value > 100 then 1 else 0 end as exemplar_count,
       e.value
from events e join v_svc s on s.b = e.user_id % 8"""
VIEWS["v_items"] = """
select 'span' as signal, service, res_service_name, env, service_version as ver from v_spans
union all select 'metric', service, res_service_name, env, null from v_metric_points
union all select 'log', service, res_service_name, env, null from v_logs"""
VIEWS["v_samples"] = """
select service, ts, sum(n) over (partition by service order by ts rows between unbounded preceding and current row) as requests_total,
       sum(err) over (partition by service order by ts rows between unbounded preceding and current row) as errors_total
from (select service, date_trunc('hour', ts) as ts, count(*) as n, sum(case when severity = 17 then 1 else 0 end) as err
      from v_logs group by service, date_trunc('hour', ts)) h"""
VIEWS["v_usage"] = """
select source as service, lang as team,
       case doc_id % 3 when 0 then 'metrics' when 1 then 'logs' else 'traces' end as signal,
       cast(n_chars as bigint) * 1000000 as ingest_bytes,
       case when doc_id % 3 = 0 then n_chars * 100 else 0 end as active_series
from documents"""
VIEWS["v_storage"] = """
select case page_id % 4 when 0 then '' when 1 then 'STANDARD' when 2 then 'STANDARD_IA' else 'GLACIER_IR' end as storage_class,
       cast(length(html) as bigint) * 1000000 as bytes
from pages"""
VIEWS["v_truth"] = """
select distinct l_orderkey as scenario, 'deployment/shop/supp-' || cast(l_suppkey as varchar) as entity
from lineitem where l_returnflag = 'R'"""
VIEWS["v_diagnosis"] = """
select distinct l_orderkey as scenario, 'deployment/shop/supp-' || cast(l_suppkey as varchar) as entity
from lineitem where l_linestatus = 'O'"""
