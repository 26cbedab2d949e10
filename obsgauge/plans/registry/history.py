"""Registered queries: presence, ratios, replay, incident attribution, diff, calibration, run health."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.ranks import robust_stats as exact_stats
from obsgauge.operators import aggregates as agg
from obsgauge.operators import calibrate, judge, replay, runhealth, series
from obsgauge.plans.catalogue import catalogue_frame
from obsgauge.plans.flows import AGGREGATES, backtest_run, long_aggregates
from obsgauge.plans.registry.base import TS, VIEWS, query
from obsgauge.plans.registry.score import daily_findings
from obsgauge.sources.tables import Tables

HOUR = 3600


def grid_over(rows: DataFrame, step_s: int, ts: str = "ts") -> series.Grid:
    """The steps from the first to the last time of ``rows``, rounded out to whole steps since the epoch."""
    first, last = rows.agg(F.floor(F.min(F.unix_micros(ts)) / (step_s * 1_000_000)), F.ceil(F.max(F.unix_micros(ts)) / (step_s * 1_000_000))).first()
    if first is None:
        raise ValueError("no times to lay a grid over")
    at = lambda k: datetime.fromtimestamp(k * step_s, timezone.utc)
    return series.Grid(at(first), at(max(last, first + 1)), step_s)


def fine(t: Tables) -> series.Grid:
    return grid_over(t.logs(), 600)


def hourly(t: Tables) -> series.Grid:
    return grid_over(t.logs(), HOUR)


GRACE_S = 300

HIGH_ERR = replay.AlertSpec("HighErr", (3 * HOUR,), 0.4, for_s=2 * HOUR, severity="page")
HIGH_ERR_NOW = replay.AlertSpec("HighErrNow", (3 * HOUR,), 0.4, severity="page")
BURN_WINDOW = replay.BurnWindow(3 * HOUR, 24 * HOUR, 1.4, 2 * HOUR, "ticket")
BURN = replay.burn_rate_alerts("errors", 0.8, [BURN_WINDOW])
BURN_NAME = BURN[0].name
ALERTS = [HIGH_ERR, HIGH_ERR_NOW, *BURN]
RULES = [a.name for a in ALERTS]

# --- SQL side ---------------------------------------------------------------------------------

for _name, _step in (("v_fine", 600), ("v_hour", HOUR)):
    VIEWS[f"{_name}_range"] = f"""
select make_timestamp(floor(epoch_us(min(ts)) / {_step}e6)::bigint * {_step} * 1000000) as t0,
       greatest(ceil(epoch_us(max(ts)) / {_step}e6)::bigint - floor(epoch_us(min(ts)) / {_step}e6)::bigint, 1) as last from v_logs"""
VIEWS["v_fine_grid"] = """
select position, t0 + to_seconds(position * 600) as t from (select t0, unnest(range(0, last + 1)) as position from v_fine_range) r"""
VIEWS["v_fine_presence"] = """
select g.position, g.t, bool_or(l.ts is not null) as has_data
from v_fine_grid g left join v_logs l on l.ts > g.t - interval 10 minute and l.ts <= g.t group by g.position, g.t"""
VIEWS["v_fine_segments"] = """
select min(t) as start_ts, max(t) as end_ts from (
  select t, position - row_number() over (order by position) as grp from v_fine_presence where has_data) x group by grp"""
VIEWS["v_hours"] = """
select position, t0 + to_seconds(position * 3600) as t from (select t0, unnest(range(0, last + 1)) as position from v_hour_range) r"""
# Probe of the replay: sign-up histograms, rare enough to leave holes.
VIEWS["v_present_hours"] = """
select distinct g.position from v_hours g
join (select ts from v_metric_points where type = 'histogram') p on p.ts > g.t - interval 1 hour and p.ts <= g.t"""
VIEWS["v_segments"] = """
select min(position) as first_pos, max(position) as last_pos from (
  select position, position - row_number() over (order by position) as grp from v_present_hours) x group by grp"""
VIEWS["v_segment_times"] = """
select first_pos, last_pos, (select t0 from v_hour_range) + to_seconds(first_pos * 3600) as start_ts,
       (select t0 from v_hour_range) + to_seconds(last_pos * 3600) as end_ts from v_segments"""
VIEWS["v_coverage"] = "select count(*) as segments, sum((last_pos - first_pos) * 3600)::double as covered_s from v_segments"
VIEWS["v_increases"] = """
select service, ts, coalesce(requests_total - lag(requests_total) over w, 0) as n,
       coalesce(errors_total - lag(errors_total) over w, 0) as e
from v_samples window w as (partition by service order by ts)"""
VIEWS["v_step_grid"] = """
select s.service, g.position, g.t, coalesce(i.n, 0) as n, coalesce(i.e, 0) as e
from (select distinct service from v_samples) s cross join v_hours g
left join v_increases i on i.service = s.service and i.ts = g.t"""
VIEWS["v_ratios"] = """
select service, position, t, case when n3 > 0 then e3 / n3::double end as ratio_3h,
       case when n24 > 0 then e24 / n24::double end as ratio_24h
from (select service, position, t, sum(n) over w3 as n3, sum(e) over w3 as e3, sum(n) over w24 as n24, sum(e) over w24 as e24
      from v_step_grid
      window w3 as (partition by service order by position rows between 2 preceding and current row),
             w24 as (partition by service order by position rows between 23 preceding and current row)) x"""
VIEWS["v_true_steps"] = f"""
select 'HighErr' as rule, 2 as for_steps, service, position from v_ratios where ratio_3h > 0.4
union all select 'HighErrNow', 0, service, position from v_ratios where ratio_3h > 0.4
union all select '{BURN_NAME}', 2, service, position from v_ratios where ratio_3h > {BURN[0].threshold!r} and ratio_24h > {BURN[0].threshold!r}"""
VIEWS["v_firings"] = """
select rule, service, first_pos as segment, a as active_pos, a + for_steps as fired_pos,
       case when b < last_pos then b + 1 end as resolved_pos,
       (select t0 from v_hour_range) + to_seconds((a + for_steps) * 3600) as fired_at
from (select rule, service, for_steps, first_pos, last_pos, min(position) as a, max(position) as b
      from (select s.*, g.first_pos, g.last_pos, s.position - row_number() over
              (partition by rule, service, g.first_pos order by s.position) as grp
            from v_true_steps s join v_segments g on s.position between g.first_pos and g.last_pos) x
      group by rule, service, for_steps, first_pos, last_pos, grp) y
where b - a >= for_steps"""
VIEWS["v_incidents"] = """
select 'inc-' || event_id as id, s as start_ts,
       s + to_seconds(case event_id % 5 when 0 then 30 when 1 then 10800 when 2 then 43200 when 3 then 172800 else 777600 end) as end_ts,
       case event_id % 3 when 1 then 'HighErr' when 2 then 'OtherRule' end as expected_alert
from (select event_id, date_trunc('hour', ts) + to_days(case when event_id % 11 = 0 then 60 else 0 end) as s from events where event_id % 31 = 0) e"""
VIEWS["v_covered"] = """
select * from v_incidents i where exists (
  select 1 from v_segment_times s where i.start_ts < s.end_ts and i.end_ts > s.start_ts)"""
VIEWS["v_attributed"] = """
select f.rule, f.service, f.fired_at, i.id as incident, i.start_ts, i.expected_alert
from v_firings f join v_covered i
  on f.fired_at >= i.start_ts - interval 300 second and f.fired_at <= i.end_ts + interval 300 second"""
VIEWS["v_detections"] = """
select rule, incident, greatest(0, epoch(min(fired_at)) - epoch(min(start_ts)))::double as ttd_s, count(*) as firings
from v_attributed where expected_alert is null or expected_alert = rule group by rule, incident"""
VIEWS["v_rule_names"] = "select * from (values " + ", ".join(f"('{r}')" for r in RULES) + ") as t(rule)"
VIEWS["v_missed"] = """
select r.rule, i.id as incident from v_rule_names r cross join v_covered i
where not exists (select 1 from v_detections d where d.rule = r.rule and d.incident = i.id)"""
VIEWS["v_false_positives"] = """
select rule, service, fired_at from v_firings f where not exists (
  select 1 from v_covered i where f.fired_at >= i.start_ts - interval 300 second and f.fired_at <= i.end_ts + interval 300 second)"""
VIEWS["v_pages"] = """
select r.rule, count(f.rule) as firings,
       count(f.rule) / ((select covered_s from v_coverage) / 3600) * 168 as pages_per_week
from v_rule_names r left join v_firings f on f.rule = r.rule group by r.rule"""


def _at(column: str) -> str:
    return f"strftime((select t0 from v_hour_range) + to_seconds({column} * 3600), {TS})"


# --- Spark side -------------------------------------------------------------------------------

def _probe(t: Tables) -> DataFrame:
    return t.points().where(F.col("type") == "histogram").select("ts")


def _segments(t: Tables) -> DataFrame:
    return series.presence_segments(_probe(t), hourly(t))


def _coverage(t: Tables) -> DataFrame:
    return series.coverage(_segments(t), hourly(t))


def _firings(t: Tables, alerts=ALERTS) -> DataFrame:
    return replay.replay_alerts(t.samples(), _segments(t), alerts, hourly(t), ["service"],
                                "errors_total", "requests_total")


def _covered(t: Tables) -> DataFrame:
    return judge.covered_incidents(t.incidents(), _segments(t))


def _detections(t: Tables) -> DataFrame:
    return judge.detections(judge.attribute_firings(judge.fire_times(_firings(t)), _covered(t), GRACE_S))


@query("presence_grid", f"select position, strftime(t, {TS}) as ts, has_data from v_fine_presence")
def presence_grid(t: Tables) -> DataFrame:
    return series.presence_grid(t.logs(), fine(t))


@query("presence_segments", f"""
select strftime(start_ts, {TS}) as start_ts, strftime(end_ts, {TS}) as end_ts from v_fine_segments""")
def presence_segments(t: Tables) -> DataFrame:
    return series.presence_segments(t.logs(), fine(t)).select("start_ts", "end_ts")


@query("coverage", """
select count(*) as segments, sum(epoch(end_ts) - epoch(start_ts))::double as covered_s,
       round(sum(epoch(end_ts) - epoch(start_ts)) / any_value(last * 600.0), 6)::double as share,
       sum(epoch(end_ts) - epoch(start_ts)) < any_value(last * 600) as partial from v_fine_segments, v_fine_range""")
def coverage(t: Tables) -> DataFrame:
    return series.coverage(series.presence_segments(t.logs(), fine(t)), fine(t))


@query("usable_start", f"""
select strftime(min(t), {TS}) as usable_from, bool_or(position = (select last from v_fine_range)) as data_at_end from v_fine_presence where has_data""")
def usable_start(t: Tables) -> DataFrame:
    return series.usable_start(t.logs(), fine(t))


@query("windowed_ratio", f"""
select service, strftime(t, {TS}) as ts, round(ratio_3h, 6) as ratio_10800 from v_ratios where ratio_3h is not null""")
def windowed_ratio(t: Tables) -> DataFrame:
    return (series.windowed_ratio(t.samples(), hourly(t), ["service"], "errors_total", "requests_total", [3 * HOUR])
            .where(F.col("ratio_10800").isNotNull()).select("service", "ts", "ratio_10800"))


@query("derived_series", f"""
select service, strftime(t, {TS}) as ts, round(ratio_24h, 6) as value from v_ratios where ratio_24h is not null""")
def derived_series(t: Tables) -> DataFrame:
    name = "service:error_ratio:24h"
    defined = {name: lambda samples: series.windowed_ratio(
        samples, hourly(t), ["service"], "errors_total", "requests_total", [24 * HOUR])
        .where(F.col("ratio_86400").isNotNull()).select("service", "ts", F.col("ratio_86400").alias("value"))}
    return series.derived_series(name, t.samples(), defined)


@query("replay_firings", f"""
select rule, service, {_at('segment')} as segment_start, {_at('active_pos')} as active_at, {_at('fired_pos')} as fired_at,
       {_at('resolved_pos')} as resolved_at from v_firings""")
def replay_firings(t: Tables) -> DataFrame:
    return _firings(t)


@query("instant_vs_for", """
select rule, count(*) as firings from v_firings where rule in ('HighErr', 'HighErrNow') group by rule""")
def instant_vs_for(t: Tables) -> DataFrame:
    return replay.pages_by_rule(_firings(t, [HIGH_ERR, HIGH_ERR_NOW]))


@query("burn_rate", f"""
select rule, service, {_at('active_pos')} as active_at, {_at('fired_pos')} as fired_at, {_at('resolved_pos')} as resolved_at
from v_firings where rule = '{BURN_NAME}'""")
def burn_rate(t: Tables) -> DataFrame:
    return _firings(t, BURN).drop("segment_start")


@query("covered_incidents", "select id as incident from v_covered")
def covered_incidents(t: Tables) -> DataFrame:
    return _covered(t).select("incident")


@query("unverifiable", "select id as incident from v_incidents where id not in (select id from v_covered)")
def unverifiable(t: Tables) -> DataFrame:
    return judge.unverifiable(t.incidents(), _covered(t)).select("incident")


@query("attributed_firings", f"select rule, service, strftime(fired_at, {TS}) as fired_at, incident from v_attributed")
def attributed_firings(t: Tables) -> DataFrame:
    return judge.attribute_firings(_firings(t), _covered(t), GRACE_S).select("rule", "service", "fired_at", "incident")


@query("detections", "select rule, incident, ttd_s, firings from v_detections")
def detections(t: Tables) -> DataFrame:
    return _detections(t)


@query("missed", "select rule, incident from v_missed")
def missed(t: Tables) -> DataFrame:
    return judge.missed(_covered(t), _detections(t), RULES)


@query("false_positives", f"select rule, service, strftime(fired_at, {TS}) as fired_at from v_false_positives")
def false_positives(t: Tables) -> DataFrame:
    return judge.false_positives(_firings(t), _covered(t), GRACE_S).select("rule", "service", "fired_at")


@query("pages_per_week", "select rule, firings, round(pages_per_week, 6) as pages_per_week from v_pages")
def pages_per_week(t: Tables) -> DataFrame:
    return judge.pages_per_week(judge.fire_times(_firings(t)), _coverage(t), RULES)


@query("flappiness", "select rule, round(avg(firings), 6) as flappiness from v_detections group by rule")
def flappiness(t: Tables) -> DataFrame:
    return judge.flappiness(_detections(t))


@query("scorecard", """
select p.rule, coalesce(d.detected, '') as detected, round(d.mean_ttd_s, 6) as mean_ttd_s, coalesce(m.missed, '') as missed,
       (select coalesce(string_agg(id, ',' order by id), '') from v_incidents where id not in (select id from v_covered)) as unverifiable,
       coalesce(f.n, 0) as false_positives, p.firings, (select covered_s from v_coverage) as covered_s,
       round(p.pages_per_week, 6) as pages_per_week, round(coalesce(d.flappiness, 0), 6) as flappiness
from v_pages p
left join (select rule, string_agg(incident, ',' order by incident) as detected, avg(ttd_s) as mean_ttd_s,
                  avg(firings) as flappiness from v_detections group by rule) d using (rule)
left join (select rule, string_agg(incident, ',' order by incident) as missed from v_missed group by rule) m using (rule)
left join (select rule, count(*) as n from v_false_positives group by rule) f using (rule)""")
def scorecard(t: Tables) -> DataFrame:
    card = backtest_run(_probe(t), t.samples(), t.incidents(), ALERTS, hourly(t), ["service"],
                        "errors_total", "requests_total", GRACE_S).scorecard
    for c in ("detected", "missed", "unverifiable"):
        card = card.withColumn(c, F.array_join(c, ","))
    return card


SET_A, SET_B = ["HighErr", "HighErrNow"], [BURN_NAME]
VIEWS["v_set_a"] = """
select incident, min(ttd_s) as ttd_s from v_detections where rule in ('HighErr', 'HighErrNow') group by incident"""
VIEWS["v_set_b"] = f"select incident, min(ttd_s) as ttd_s from v_detections where rule = '{BURN_NAME}' group by incident"


@query("set_detections", "select incident, min(ttd_s) as ttd_s from v_detections group by incident")
def set_detections(t: Tables) -> DataFrame:
    return judge.set_detections(_detections(t))


@query("diff_lost", "select incident from v_set_a where incident not in (select incident from v_set_b)")
def diff_lost(t: Tables) -> DataFrame:
    return judge.diff_lost(judge.compare_sets(_detections(t), SET_A, SET_B))


@query("diff_gained", """
select b.incident from (select distinct incident from v_detections where rule = 'HighErrNow') b
left join (select incident from v_detections where rule = 'HighErr') a using (incident) where a.incident is null""")
def diff_gained(t: Tables) -> DataFrame:
    """What the rule without a waiting time finds that the waiting one does not."""
    return judge.diff_gained(judge.compare_sets(_detections(t), ["HighErr"], ["HighErrNow"]))


@query("diff_ttd", """
select incident, a.ttd_s as ttd_a_s, b.ttd_s as ttd_b_s, b.ttd_s - a.ttd_s as change_s
from (select incident, min(ttd_s) as ttd_s from v_detections where rule = 'HighErrNow' group by incident) a
join (select incident, min(ttd_s) as ttd_s from v_detections where rule = 'HighErr' group by incident) b using (incident)""")
def diff_ttd(t: Tables) -> DataFrame:
    return judge.diff_ttd(judge.compare_sets(_detections(t), ["HighErrNow"], ["HighErr"]))


@query("diff_verdict", """
select (select covered_s from v_coverage) as covered_s, true as comparable,
       (select count(*) from v_set_a where incident not in (select incident from v_set_b)) as lost,
       (select count(*) from v_set_a a join v_set_b b using (incident) where b.ttd_s - a.ttd_s > 600) as slower,
       round((select sum(pages_per_week) from v_pages where rule in ('HighErr', 'HighErrNow')), 6) as pages_a,
       round((select sum(pages_per_week) from v_pages where rule not in ('HighErr', 'HighErrNow')), 6) as pages_b,
       (select count(*) from v_set_a where incident not in (select incident from v_set_b)) > 0
       or (select count(*) from v_set_a a join v_set_b b using (incident) where b.ttd_s - a.ttd_s > 600) > 0
       or (select sum(pages_per_week) from v_pages where rule not in ('HighErr', 'HighErrNow')) > 50 as regression""")
def diff_verdict(t: Tables) -> DataFrame:
    times, cov = judge.fire_times(_firings(t)), _coverage(t)
    compared = judge.compare_sets(judge.detections(judge.attribute_firings(times, _covered(t), GRACE_S)), SET_A, SET_B)
    return judge.diff_verdict(compared, judge.pages_per_week(times, cov, RULES), SET_A, SET_B, cov, cov,
                              max_ttd_regression_s=600, max_pages_per_week=50)


@query("alerts_in_state", f"""
select rule, service, {_at('active_pos')} as active_at, {_at('fired_pos')} as fired_at, 'firing' as state
from v_firings where resolved_pos is null""")
def alerts_in_state(t: Tables) -> DataFrame:
    return replay.alerts_in_state(replay.alert_states(_firings(t)), "firing").select(
        "rule", "service", "active_at", "fired_at", "state")


# --- order statistics and calibration ---------------------------------------------------------

def _stats_sql(source: str, keys: str, value: str) -> str:
    """Lower median, nearest-rank percentiles and MAD by row number."""
    rank = "greatest(1, least(n, floor({p} / 100.0 * n + 0.5)::bigint))"
    return f"""
select {keys}, n, median, mad, p90, p99, mx as max from (
  select {keys}, max(n) as n, max(case when rn = (n - 1) // 2 + 1 then v end) as median,
         max(case when rn = {rank.format(p=90)} then v end) as p90, max(case when rn = {rank.format(p=99)} then v end) as p99,
         max(v) as mx
  from (select {keys}, {value}::double as v, row_number() over (partition by {keys} order by {value}) as rn,
               count(*) over (partition by {keys}) as n from {source}) a group by {keys}) s
join (select {keys}, max(case when rn = (n - 1) // 2 + 1 then d end) as mad from (
        select {keys}, d, row_number() over (partition by {keys} order by d) as rn, count(*) over (partition by {keys}) as n
        from (select {keys}, abs({value}::double - m) as d from {source} join (
                select {keys}, max(case when rn = (n - 1) // 2 + 1 then v end) as m
                from (select {keys}, {value}::double as v, row_number() over (partition by {keys} order by {value}) as rn,
                             count(*) over (partition by {keys}) as n from {source}) b group by {keys}) c using ({keys})) e) f
      group by {keys}) g using ({keys})"""


VIEWS["v_value_stats"] = _stats_sql("v_metric_points", "service, name", "value")


@query("robust_stats", """
select service, name, n, round(median, 6) as median, round(mad, 6) as mad, round(p90, 6) as p90, round(p99, 6) as p99,
       round(max, 6) as max from v_value_stats""")
def robust_stats(t: Tables) -> DataFrame:
    return exact_stats(t.points(), ["service", "name"], "value")


VIEWS["v_calibration_values"] = """
select 'MET-001' as rule_id, cardinality::double as value from v_attr_cardinality
union all select 'SPA-003', cardinality from v_span_names
union all select 'EXT-RES-004', cardinality from v_resource_attrs
union all select 'SPA-002', orphan_ratio from v_trace_health
union all select 'EXT-SPA-002', missing_root_ratio from v_trace_health
union all select rule_id, ratio from v_daily_ratios where rule_id = 'EXT-LOG-001' and ratio > 0.5"""
VIEWS["v_calibration_stats"] = _stats_sql("v_calibration_values", "rule_id", "value")
VIEWS["v_proposals"] = """
select rule_id, param, kind, current, n, median, mad, p90, p99, max,
       case kind when 'count' then ceil(2 * p99 / unit) * unit when 'small_count' then ceil(p99) + 1
            else least(1, floor((p99 + greatest(0.05, 2 * mad)) * 100 + 0.5) / 100) end::double as proposed
from (select *, case when p99 > 0 then pow(10.0, floor(log10(2 * p99)) - 1) else 1 end as unit from v_calibration_stats) s
join (values ('MET-001', 'max_cardinality', 'count', 10000.0::double), ('SPA-003', 'max_span_names', 'count', 200.0::double),
             ('EXT-RES-004', 'max_values', 'small_count', 3.0::double), ('SPA-002', 'max_orphan_ratio', 'ratio', 0.1::double),
             ('EXT-SPA-002', 'max_missing_root_ratio', 'ratio', 0.2::double),
             ('EXT-LOG-001', 'threshold_ratio', 'ratio', 0.5::double)) as t(rule_id, param, kind, current) using (rule_id)"""


def _proposals(t: Tables) -> DataFrame:
    names = [n for n in AGGREGATES if n not in ("exemplar_coverage", "histogram_bucket_signatures")]
    signals = t.signals(names=True)
    aggregates = long_aggregates({n: AGGREGATES[n](signals) for n in names})
    ratios = daily_findings(t).select("rule_id", "ratio")
    return calibrate.propose_thresholds(aggregates, ratios, catalogue_frame(t.spark))


@query("propose_thresholds", """
select rule_id, param, kind, current, round(proposed, 6) as proposed, n, round(median, 6) as median, round(mad, 6) as mad,
       round(p90, 6) as p90, round(p99, 6) as p99, round(max, 6) as max from v_proposals""")
def propose_thresholds(t: Tables) -> DataFrame:
    return _proposals(t)


@query("override_rules", """
select rule_id, case when param = 'threshold_ratio' then '' when rule_id = 'MET-001' then param || '=' || text || ',window_s=3600'
       else param || '=' || text end as params,
       case when param = 'threshold_ratio' then round(proposed, 6) else 0 end::double as threshold_ratio
from (select *, case when proposed = floor(proposed) then proposed::bigint::varchar else proposed::varchar end as text
      from v_proposals) x""")
def override_rules(t: Tables) -> DataFrame:
    changed = calibrate.override_rules(catalogue_frame(t.spark), _proposals(t))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("params"), lambda e: F.concat_ws(
        "=", e["key"], e["value"]))), ",")
    return changed.select("rule_id", text.alias("params"), "threshold_ratio")


# --- run health -------------------------------------------------------------------------------

VIEWS["v_ticks"] = """
select service as run, make_timestamp((epoch_us(ts) // 600000000) * 600000000) as ts, max(value) as rss,
       count(distinct attr_k)::double as pairs, sum(case when name = 'errors' then 1 else 0 end) as e, count(*) as n
from v_metric_points group by 1, 2"""
VIEWS["v_run_samples"] = """
select run, ts, rss, pairs, (sum(e) over d)::double as evictions, (sum(n) over d)::double as items
from v_ticks window d as (partition by run, date_trunc('day', ts) order by ts rows between unbounded preceding and current row)"""
VIEWS["v_run_steps"] = """
select *, epoch(ts) - epoch(prev_ts) as step_s from (
  select run, ts, items, pairs, lag(ts) over w as prev_ts, lag(items) over w as prev_items, lag(pairs) over w as prev_pairs
  from v_run_samples window w as (partition by run order by ts)) x"""
VIEWS["v_run_limit"] = """
select run, greatest(120.0, 3 * max(case when rn = (n - 1) // 2 + 1 then step_s end)) as limit_s from (
  select run, step_s, row_number() over (partition by run order by step_s) as rn, count(*) over (partition by run) as n
  from v_run_steps where prev_ts is not null) x group by run"""


@query("run_continuity", """
select run, count(*) as samples, count(*) filter (step_s > limit_s) as gaps,
       coalesce(max(step_s) filter (step_s > limit_s), 0)::double as longest_gap_s,
       count(*) filter (items < prev_items) as restarts,
       count(*) filter (step_s > limit_s) > 0 or count(*) filter (items < prev_items) > 0 as segmented
from v_run_steps join v_run_limit using (run) group by run""")
def run_continuity(t: Tables) -> DataFrame:
    return runhealth.run_continuity(t.run_samples())


@query("run_gaps", f"""
select run, strftime(prev_ts, {TS}) as after, step_s::double as missing_s
from v_run_steps join v_run_limit using (run) where step_s > limit_s""")
def run_gaps(t: Tables) -> DataFrame:
    return runhealth.run_gaps(t.run_samples())


@query("memory_verdict", """
with kept as (
  select run, ex, ts, rss, row_number() over (partition by run, ex order by ts) as rn, count(*) over (partition by run, ex) as n
  from v_run_samples s join (select run, min(ts) as t0 from v_run_samples group by run) a using (run)
  cross join (values (false), (true)) w(ex) where not ex or ts >= t0 + interval 2 hour),
ends as (
  select run, ex, n, 'f' as part, rss from kept where rn <= greatest(1, n // 4)
  union all select run, ex, n, 'l', rss from kept where rn > n - greatest(1, n // 4)),
med as (
  select run, ex, n, part, max(case when rn = (c - 1) // 2 + 1 then rss end) as m from (
    select *, row_number() over (partition by run, ex, part order by rss) as rn, count(*) over (partition by run, ex, part) as c
    from ends) x group by run, ex, n, part)
select f.run, f.n as samples, f.ex as warmup_excluded, f.m as first_rss, l.m as last_rss,
       round((l.m - f.m) / f.m * 100, 6) as growth_percent, (l.m - f.m) / f.m * 100 <= 15 as flat
from med f join med l on l.run = f.run and l.ex = f.ex where f.part = 'f' and l.part = 'l'""".replace("with kept", "select * from (with kept") + ") z")
def memory_verdict(t: Tables) -> DataFrame:
    return runhealth.memory_verdict(t.run_samples())


@query("run_throughput", """
select s.run, rotated, evictions, epoch(b) - epoch(a) as elapsed_s, round((i1 - i0) / (epoch(b) - epoch(a)), 6) as items_per_s
from (select run, min(ts) as a, max(ts) as b, arg_min(items, ts) as i0, arg_max(items, ts) as i1,
             arg_max(evictions, ts) as evictions from v_run_samples group by run) s
join (select run, coalesce(bool_or(pairs < prev_pairs and prev_pairs > 0), false) as rotated from v_run_steps group by run) r
  on r.run = s.run""")
def run_throughput(t: Tables) -> DataFrame:
    return runhealth.run_throughput(t.run_samples())


VIEWS["v_long_card"] = """
select 'metric_attribute_cardinality' as aggregate, service || '/' || metric || '/' || attribute as label, cardinality::double as value
from v_attr_cardinality
union all select 'span_name_cardinality', service, cardinality from v_span_names
union all select 'resource_attr_cardinality', service || '/' || attribute, cardinality from v_resource_attrs"""
VIEWS["v_long_stats"] = _stats_sql("v_long_card", "aggregate", "value")


@query("aggregate_distribution", """
select s.aggregate, 'cardinality' as measure, n, median, p90, p99, max, top
from v_long_stats s join (
  select aggregate, min(label) as top from v_long_card l
  where value = (select max(value) from v_long_card x where x.aggregate = l.aggregate) group by aggregate) m
on m.aggregate = s.aggregate""")
def aggregate_distribution(t: Tables) -> DataFrame:
    signals = t.signals(names=True)
    frames = {n: AGGREGATES[n](signals) for n in
              ("metric_attribute_cardinality", "span_name_cardinality", "resource_attr_cardinality")}
    return runhealth.aggregate_distribution(long_aggregates(frames))


@query("exemplar_services", """
select count(*) filter (with_exemplars > 0) as with_exemplars, count(*) as services from v_exemplars""")
def exemplar_services(t: Tables) -> DataFrame:
    return runhealth.exemplar_services(agg.exemplar_coverage(t.points()))
