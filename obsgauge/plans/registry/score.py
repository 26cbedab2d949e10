"""Registered queries: item rules, aggregates, roll-up, scores, findings, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.functions import attributes as attr
from obsgauge.operators import aggregates as agg
from obsgauge.operators import rules as rule_ops
from obsgauge.operators import scoring, traces
from obsgauge.operators import spend as spend_ops
from obsgauge.plans.catalogue import (
    DEFAULT_RULES,
    ITEM_RULES,
    UNIT_IN_NAME,
    catalogue_frame,
    rule,
    rules_merge,
    with_params,
)
from obsgauge.plans.flows import AGGREGATES, Scoring
from obsgauge.plans.registry.base import TS, VIEWS, query
from obsgauge.schemas import VALUE
from obsgauge.sources import backend, snapshots
from obsgauge.sources.otlp import value_text
from obsgauge.sources.tables import Tables

# --- SQL side: verdicts, roll-up, scores ------------------------------------------------------

_ITEM_SQL = {
    "RES-005": ("v_items", "coalesce(res_service_name, '') <> ''"),
    "EXT-RES-001": ("v_items", "res_service_name is null or not starts_with(res_service_name, 'unknown_service')"),
    "EXT-RES-002": ("v_items", "coalesce(ver, '') <> ''"),
    "EXT-RES-003": ("v_items", "coalesce(env, '') <> ''"),
    "LOG-001": ("v_logs", "not (coalesce(starts_with(env, 'prod'), false) and severity >= 5 and severity <= 8)"),
    "LOG-002": ("v_logs", "severity <> 0"),
    "EXT-LOG-001": ("v_logs", "has_trace_id"),
    "MET-002": ("v_metric_points", "unit <> ''"),
    "MET-005": ("v_metric_points", f"not regexp_matches(name, '{UNIT_IN_NAME}')"),
    "EXT-MET-002": ("v_metric_points", "type <> 'histogram' or bounds_id <> 0"),
    "SPA-004": ("v_spans", "parent_span_id is not null or kind <> 'client'"),
}
_AGG_SQL = {
    "MET-001": ("v_attr_cardinality", "cardinality < 10000"),
    "MET-004": ("v_bucket_signatures", "cardinality <= 1"),
    "SPA-002": ("v_trace_health", "orphan_ratio <= 0.1"),
    "SPA-003": ("v_span_names", "cardinality < 200"),
    "EXT-MET-001": ("v_exemplars", "histogram_points = 0 or with_exemplars > 0"),
    "EXT-RES-004": ("v_resource_attrs", "cardinality <= 3"),
    "EXT-SPA-002": ("v_trace_health", "missing_root_ratio <= 0.2"),
}

VIEWS["v_attr_cardinality"] = """
select service, name as metric, 'k' as attribute, count(distinct attr_k) as cardinality
from v_metric_points group by service, name"""
VIEWS["v_bucket_signatures"] = """
select service, name as metric, count(distinct bounds_id) as cardinality
from v_metric_points where type = 'histogram' group by service, name"""
VIEWS["v_span_names"] = "select service, count(distinct name) as cardinality from v_spans group by service"
VIEWS["v_resource_attrs"] = """
select service, attribute, count(distinct value) as cardinality from (
  select service, 'service.version' as attribute, ver as value from v_items
  union all select service, 'deployment.environment.name', env from v_items) x
where value is not null group by service, attribute"""
VIEWS["v_exemplars"] = """
select service, count(*) as histogram_points, sum(case when exemplar_count > 0 then 1 else 0 end)::bigint as with_exemplars
from v_metric_points where type = 'histogram' group by service"""
VIEWS["v_links"] = """
select s.trace_id, s.service, s.parent_span_id, p.span_id as found, p.service as caller
from v_spans s left join (select trace_id, span_id, min(service) as service from v_spans group by 1, 2) p
  on p.trace_id = s.trace_id and p.span_id = s.parent_span_id"""
VIEWS["v_trace_service"] = """
select trace_id, service, bool_or(parent_span_id is not null and found is null) as dangling from v_links
group by trace_id, service"""
VIEWS["v_trace_flags"] = """
select trace_id, not bool_or(parent_span_id is null) as rootless,
       bool_or(parent_span_id is not null and found is null) as broken
from v_links group by trace_id"""
VIEWS["v_trace_health"] = """
select service, count(*) as traces,
       sum(case when dangling then 1 else 0 end) / count(*)::double as orphan_ratio,
       sum(case when rootless and (dangling or not broken) then 1 else 0 end) / count(*)::double as missing_root_ratio
from v_trace_service join v_trace_flags using (trace_id) group by service"""
VIEWS["v_edges"] = """
select caller, service as callee, count(distinct trace_id) as traces
from v_links where found is not null and caller <> service group by caller, service"""
VIEWS["v_verdicts"] = "\nunion all ".join(
    f"select '{rid}' as rule_id, service, ({cond}) as passed from {src}"
    for rid, (src, cond) in {**_ITEM_SQL, **_AGG_SQL}.items())
VIEWS["v_rules"] = "select * from (values " + ", ".join(
    f"('{r.rule_id}', '{r.source}', '{r.impact}', {attr.IMPACT_WEIGHTS[r.impact]}, {r.threshold_ratio})"
    for r in DEFAULT_RULES) + ") as t(rule_id, source, impact, weight, threshold_ratio)"
VIEWS["v_rollup"] = """
select service, rule_id, count(*) as observed, sum(case when passed then 0 else 1 end)::bigint as violations
from v_verdicts group by service, rule_id"""
VIEWS["v_results"] = """
select r.service, r.rule_id, c.source, c.impact, c.weight, r.observed, r.violations,
       r.violations / r.observed::double as ratio,
       r.violations / r.observed::double <= c.threshold_ratio as passed
from v_rollup r join v_rules c using (rule_id)"""
_SCORE = "coalesce(100.0 * sum(case when {c} and passed then weight else 0 end) / sum(case when {c} then weight end), {d})"
VIEWS["v_scores"] = f"""
select service, {_SCORE.format(c="source = 'spec'", d="100.0")}::double as spec_score,
       {_SCORE.format(c="source = 'extension'", d="null")}::double as extension_score,
       sum(case when passed then 0 else 1 end)::bigint as findings
from v_results group by service"""
_BAND = ("case when spec_score >= 90 then 'Excellent' when spec_score >= 75 then 'Good' "
         "when spec_score >= 50 then 'Needs Improvement' else 'Poor' end")


def _scoring(t: Tables) -> Scoring:
    return Scoring(t.spark, t.signals(names=True))


# --- item rules -------------------------------------------------------------------------------

def _signals_for(t: Tables, target: str) -> dict[str, DataFrame]:
    if target == "resource":
        return t.signals()
    return {target: {"span": t.spans, "metric": t.points, "log": t.logs}[target]()}


def _register_item_rule(rule_id: str) -> None:
    r = rule(rule_id)
    source, condition = _ITEM_SQL[rule_id]
    sql = f"""
select service, count(*) as observed, sum(case when {condition} then 0 else 1 end)::bigint as violations,
       round(sum(case when {condition} then 0 else 1 end) / count(*)::double, 6) as ratio,
       sum(case when {condition} then 0 else 1 end) / count(*)::double <= {r.threshold_ratio} as passed
from {source} group by service"""

    @query("rule_" + rule_id.lower().replace("-", "_"), sql)
    def run(t: Tables) -> DataFrame:
        rollup = rule_ops.item_rollup(_signals_for(t, r.target), [r])
        return rule_ops.rule_results(rollup, catalogue_frame(t.spark, [r])).select(
            "service", "observed", "violations", "ratio", "passed")


for _r in ITEM_RULES:
    _register_item_rule(_r.rule_id)


# --- aggregates and their rules ---------------------------------------------------------------

def _register_aggregate_rule(rule_id: str, columns: list[str]) -> None:
    r = rule(rule_id)
    source, condition = _AGG_SQL[rule_id]
    shown = ", ".join(f"round({c}, 6) as {c}" if c.endswith("ratio") else c for c in columns)

    @query("rule_" + rule_id.lower().replace("-", "_"), f"select {shown}, ({condition}) as passed from {source}")
    def run(t: Tables) -> DataFrame:
        signals = {"span": t.spans(names=r.aggregate == "span_name_cardinality"), "metric": t.points(), "log": t.logs()}
        return rule_ops.aggregate_verdicts(AGGREGATES[r.aggregate](signals), r).select(*columns, "passed")


_register_aggregate_rule("MET-001", ["service", "metric", "attribute", "cardinality"])
_register_aggregate_rule("MET-004", ["service", "metric", "cardinality"])
_register_aggregate_rule("SPA-002", ["service", "traces", "orphan_ratio"])
_register_aggregate_rule("SPA-003", ["service", "cardinality"])
_register_aggregate_rule("EXT-MET-001", ["service", "histogram_points", "with_exemplars"])
_register_aggregate_rule("EXT-RES-004", ["service", "attribute", "cardinality"])
_register_aggregate_rule("EXT-SPA-002", ["service", "traces", "missing_root_ratio"])


@query("bucket_signatures", "select service, metric, cardinality from v_bucket_signatures")
def bucket_signatures(t: Tables) -> DataFrame:
    return agg.histogram_bucket_signatures(t.points())


@query("attr_cardinality", "select service, metric, attribute, cardinality from v_attr_cardinality")
def attr_cardinality(t: Tables) -> DataFrame:
    return agg.metric_attribute_cardinality(t.points())


@query("span_name_cardinality", "select service, cardinality from v_span_names")
def span_name_cardinality(t: Tables) -> DataFrame:
    return agg.span_name_cardinality(t.spans(names=True))


@query("resource_attr_cardinality", "select service, attribute, cardinality from v_resource_attrs")
def resource_attr_cardinality(t: Tables) -> DataFrame:
    return agg.resource_attr_cardinality(t.signals())


@query("exemplar_coverage", "select service, histogram_points, with_exemplars from v_exemplars")
def exemplar_coverage(t: Tables) -> DataFrame:
    return agg.exemplar_coverage(t.points())


@query("trace_health", """
select service, traces, round(orphan_ratio, 6) as orphan_ratio, round(missing_root_ratio, 6) as missing_root_ratio
from v_trace_health""")
def trace_health(t: Tables) -> DataFrame:
    return traces.trace_health(t.spans())


#: Of this many spans a task joins, groups and sorts about 250 MB.
SPANS_A_TASK = 250_000


@query("trace_health_windowed", f"""
select service, strftime(date_trunc('day', trace_ts), {TS}) as window_start, count(*) as traces,
       round(sum(case when dangling then 1 else 0 end) / count(*)::double, 6) as orphan_ratio,
       round(sum(case when rootless and (dangling or not broken) then 1 else 0 end) / count(*)::double, 6) as missing_root_ratio
from v_trace_service join v_trace_flags using (trace_id)
join (select trace_id, min(ts) as trace_ts from v_spans group by trace_id) m using (trace_id)
where date_trunc('day', trace_ts) + interval 1 day <= (select max(ts) from v_spans)
group by service, date_trunc('day', trace_ts)""")
def trace_health_windowed(t: Tables) -> DataFrame:
    last, n = t.spans(times=True).agg(F.max("ts"), F.count("*")).first()  # windows the last span has left behind
    return traces.trace_health(t.spans(times=True, tasks=n // SPANS_A_TASK + 1), window="1 day", closed_before=last)


@query("service_dependency", "select caller, callee, traces from v_edges")
def service_dependency(t: Tables) -> DataFrame:
    return traces.service_dependency(t.spans())


VIEWS["v_hourly"] = """
select service, name as metric, 'k' as attribute, date_trunc('hour', ts) as w, count(distinct attr_k) as cardinality
from v_metric_points group by service, name, date_trunc('hour', ts)"""
VIEWS["v_live"] = """
select service, metric, attribute, w, cardinality from v_hourly
union all select service, metric, attribute, w + interval 1 hour, cardinality from v_hourly"""


@query("two_generation_max", f"""
select service, metric, attribute, strftime(w, {TS}) as window_start, max(cardinality) as cardinality
from v_live group by service, metric, attribute, w""")
def two_generation_max(t: Tables) -> DataFrame:
    hourly = agg.metric_attribute_cardinality(t.points(), window="1 hour")
    return agg.two_generation_max(hourly, ["service", "metric", "attribute"])


@query("tracked_pairs", f"""
select strftime(w, {TS}) as window_start, count(*) as pairs
from (select distinct service, metric, attribute, w from v_live) x group by w""")
def tracked_pairs(t: Tables) -> DataFrame:
    # The keys are known from the points alone; their distinct values are not counted.
    keys = ["service", "metric", "attribute"]
    return agg.tracked_pairs(agg.metric_attribute_values(t.points(), window="1 hour"), keys)


@query("mergeable_cardinality", "select service, metric, attribute, cardinality as exact, true as close from v_attr_cardinality")
def mergeable_cardinality(t: Tables) -> DataFrame:
    keys = ["service", "metric", "attribute"]
    sketches = agg.cardinality_sketches(agg.metric_attribute_values(t.points(), window="1 day"), [*keys, "window_start"])
    exact = agg.metric_attribute_cardinality(t.points()).select(*keys, F.col("cardinality").alias("exact"))
    return agg.merge_sketches(sketches, keys).join(exact, keys).select(
        *keys, "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


# --- intake and scalar functions --------------------------------------------------------------

@query("items_by_signal", "select signal, count(*) as items from v_items group by signal")
def items_by_signal(t: Tables) -> DataFrame:
    return backend.items_by_signal(t.signals())


@query("service_bucket", "select signal, service, count(*) as items from v_items group by signal, service")
def service_bucket(t: Tables) -> DataFrame:
    parts = [df.groupBy("service").agg(F.count(F.lit(1)).alias("items")).select(F.lit(s).alias("signal"), "service", "items")
             for s, df in t.signals().items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("severity_normalized", """
select severity_text, severity as severity_number, count(*) as records from v_logs group by severity_text, severity""")
def severity_normalized(t: Tables) -> DataFrame:
    return t.logs().groupBy("severity_text", "severity_number").agg(F.count(F.lit(1)).alias("records"))


@query("span_kind_name", """
select l_linenumber as code,
       case l_linenumber when 1 then 'internal' when 2 then 'server' when 3 then 'client' when 4 then 'producer'
            when 5 then 'consumer' else 'unspecified' end as kind,
       case l_linenumber when 1 then 'ok' when 2 then 'error' else 'unset' end as status, count(*) as spans
from lineitem group by l_linenumber""")
def span_kind_name(t: Tables) -> DataFrame:
    code = F.col("l_linenumber")
    return (t.read("lineitem").groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("spans"))
            .select("code", attr.span_kind_name(F.col("code")).alias("kind"),
                    attr.status_name(F.col("code")).alias("status"), "spans"))


@query("whole_attributes", "select doc_id, cast(strlen(text) as bigint) as bytes, md5(text) as digest from documents")
def whole_attributes(t: Tables) -> DataFrame:
    """Texts of any length through the intake of an attribute value."""
    typed = F.from_json(F.to_json(F.struct(F.col("text").alias("stringValue"))), VALUE)
    value = value_text(typed)
    return t.read("documents").select("doc_id", F.octet_length(value).alias("bytes"), F.md5(value).alias("digest"))


@query("series_key", """
select concat('{__name__="', name, '",k="', attr_k, '",service_name="', service, '"}') as series_key, count(*) as points
from v_metric_points group by 1""")
def series_key(t: Tables) -> DataFrame:
    return t.backend_samples().groupBy("series_key").agg(F.count(F.lit(1)).alias("points"))


@query("active_series", """
select service, count(distinct name || '/' || attr_k) as active_series from v_metric_points group by service""")
def active_series(t: Tables) -> DataFrame:
    return backend.active_series_by_service(t.backend_samples())


@query("label_cardinality", """
select 'request.duration' as metric, 'k' as attribute, count(distinct attr_k) as series
from v_metric_points where name = 'request.duration'""")
def label_cardinality(t: Tables) -> DataFrame:
    return backend.label_cardinality(t.backend_samples(), "request.duration", "k")


@query("log_bytes", """
select service, sum(body_len)::bigint as bytes from v_logs
where ts > timestamp '2024-01-31 00:00:00' - interval 7 day and ts <= timestamp '2024-01-31 00:00:00' group by service""")
def log_bytes(t: Tables) -> DataFrame:
    return backend.log_bytes_by_service(t.logs(), "2024-01-31 00:00:00", 7 * 86400)


VIEWS["v_jobs"] = "select distinct env || '/' || service as job from v_metric_points where env is not null"


@query("job_service", """
select distinct job, u.service from v_jobs, unnest([job, split_part(job, '/', -1)]) as u(service)""")
def job_service(t: Tables) -> DataFrame:
    return t.jobs().select("job", F.explode(attr.job_services(F.col("job"))).alias("service"))


@query("safe_label", r"""
select service, regexp_replace(service, '[^A-Za-z0-9_]', '_', 'g') as safe, count(*) as items from v_items group by service""")
def safe_label(t: Tables) -> DataFrame:
    counts = rule_ops._union([df.groupBy("service").agg(F.count(F.lit(1)).alias("items"))
                              for df in t.signals().values()])
    return counts.groupBy("service").agg(F.sum("items").alias("items")).withColumn(
        "safe", attr.safe_label(F.col("service")))


# --- roll-up and scores -----------------------------------------------------------------------

@query("rule_rollup", """
select service, rule_id, observed, violations, round(ratio, 6) as ratio, passed from v_results""")
def rule_rollup(t: Tables) -> DataFrame:
    return _scoring(t).results.select("service", "rule_id", "observed", "violations", "ratio", "passed")


@query("service_score", f"select service, round(spec_score, 6) as spec_score, {_BAND} as category, findings from v_scores")
def service_score(t: Tables) -> DataFrame:
    return _scoring(t).scores.select("service", "spec_score", "category", "findings")


@query("score_category", f"select {_BAND} as category, count(*) as services from v_scores group by 1")
def score_category(t: Tables) -> DataFrame:
    return _scoring(t).scores.groupBy("category").agg(F.count(F.lit(1)).alias("services"))


@query("split_scores", """
select service, round(spec_score, 6) as spec_score, round(extension_score, 6) as extension_score from v_scores""")
def split_scores(t: Tables) -> DataFrame:
    return _scoring(t).scores.select("service", "spec_score", "extension_score")


@query("fleet_score", "select round(avg(spec_score), 6) as fleet_score, count(*) as services from v_scores")
def fleet_score(t: Tables) -> DataFrame:
    return scoring.fleet_score(_scoring(t).scores)


@query("score_gate", """
select round(avg(spec_score), 6) as fleet_score, count(*) as services, avg(spec_score) < 70 as below,
       count(*) = 0 as empty_fleet from v_scores""")
def score_gate(t: Tables) -> DataFrame:
    return scoring.score_gate(_scoring(t).scores, 70.0)


@query("worst_first", """
select row_number() over (order by v_scores.spec_score, service) as place, service, round(spec_score, 6) as spec_score from v_scores""")
def worst_first(t: Tables) -> DataFrame:
    return scoring.worst_first(_scoring(t).scores).select("place", "service", "spec_score")


@query("findings", """
select service, rule_id, source, impact, observed, violations, round(ratio, 6) as ratio, 'sampled' as confidence
from v_results where not passed""")
def findings(t: Tables) -> DataFrame:
    return _scoring(t).findings.select("service", "rule_id", "source", "impact", "observed", "violations",
                                       "ratio", "confidence")


@query("finding_counts", "select rule_id, count(*) as services from v_results where not passed group by rule_id")
def finding_counts(t: Tables) -> DataFrame:
    return scoring.finding_counts(_scoring(t).findings)


@query("findings_by_impact", """
select service, impact, count(*) as findings from v_results where not passed group by service, impact""")
def findings_by_impact(t: Tables) -> DataFrame:
    return scoring.findings_by_impact(_scoring(t).findings)


@query("score_gauges", """
select 'service_score' as gauge, service, null::varchar as impact, round(spec_score, 6) as value from v_scores
union all select 'fleet_score', null, null, round(avg(spec_score), 6) from v_scores
union all select 'findings', service, impact, count(*)::double from v_results where not passed group by service, impact""")
def score_gauges(t: Tables) -> DataFrame:
    s = _scoring(t)
    return scoring.score_gauges(s.scores, s.findings)


# --- evidence ---------------------------------------------------------------------------------

VIEWS["v_violations"] = f"""
select service, rule_id, ts, kind, summary, item_id, keys from (
  select 'span_' as src, service, res_service_name, env, ts, 'span' as kind, 'span ' || name as summary,
         span_item as item_id, concat_ws(',', case when env is not null then 'deployment.environment.name' end,
         case when res_service_name is not null then 'service.name' end, 'service.version') as keys,
         [ {", ".join(f"case when {_ITEM_SQL[r][1]} then null else '{r}' end" for r in ("RES-005", "EXT-RES-001", "EXT-RES-003", "SPA-004"))} ] as failed
  from v_spans
  union all
  select 'log_', service, res_service_name, env, ts, 'log_record', 'log severity=' || severity_text, event_id::varchar,
         concat_ws(',', case when env is not null then 'deployment.environment.name' end,
         case when res_service_name is not null then 'service.name' end),
         [ 'EXT-RES-002', {", ".join(f"case when {_ITEM_SQL[r][1]} then null else '{r}' end" for r in ("RES-005", "EXT-RES-001", "EXT-RES-003", "LOG-001", "LOG-002", "EXT-LOG-001"))} ]
  from v_logs
  union all
  select 'metric_', service, res_service_name, env, ts, 'metric_point', 'metric ' || name, event_id::varchar, 'k',
         [ 'EXT-RES-002', {", ".join(f"case when {_ITEM_SQL[r][1]} then null else '{r}' end" for r in ("RES-005", "EXT-RES-001", "EXT-RES-003", "MET-002", "MET-005", "EXT-MET-002"))} ]
  from v_metric_points) x, unnest(failed) as u(rule_id) where rule_id is not null"""
VIEWS["v_item_evidence"] = """
select * from (select *, row_number() over (partition by service, rule_id order by ts, kind, length(item_id), item_id) as rank
               from v_violations) x where rank <= 5"""


def _item_evidence(t: Tables) -> DataFrame:
    return scoring.item_evidence(t.signals(names=True, times=True), ITEM_RULES, 5)


@query("item_evidence", "select service, rule_id, rank, kind, summary, item_id from v_item_evidence")
def item_evidence(t: Tables) -> DataFrame:
    return _item_evidence(t).select("service", "rule_id", "rank", "kind", "summary", "item_id")


@query("redacted_evidence", """
select service, rule_id, rank, kind, '' as summary, keys, true as hidden from v_item_evidence""")
def redacted_evidence(t: Tables) -> DataFrame:
    lists = scoring.evidence_lists(_item_evidence(t)).select(
        "service", "rule_id", F.posexplode(attr.redact_evidence(F.col("evidence"))).alias("rank", "e"))
    return lists.select("service", "rule_id", (F.col("rank") + 1).alias("rank"), F.col("e.kind").alias("kind"),
                        F.col("e.summary").alias("summary"),
                        F.array_join(F.array_sort(F.map_keys("e.attrs")), ",").alias("keys"),
                        F.forall(F.map_values("e.attrs"), lambda v: v == attr.REDACTED).alias("hidden"))


@query("aggregate_evidence", f"""
select service, rule_id, rank, strftime(w, {TS}) as window_start, metric, cardinality from (
  select *, 'MET-001' as rule_id, row_number() over (partition by service order by w desc, metric) as rank
  from v_hourly where not cardinality < 2) x where rank <= 5""")
def aggregate_evidence(t: Tables) -> DataFrame:
    hourly = agg.metric_attribute_cardinality(t.points(), window="1 hour")
    strict = with_params(rule("MET-001"), max_cardinality=2)
    kept = scoring.aggregate_evidence(hourly, [strict], "metric_attribute_cardinality", ["window_start", "metric"], 5)
    return kept.select("service", "rule_id", "rank", "window_start", "metric", "cardinality")


#: MET-001 with a limit the test data exceeds.
STRICT = with_params(rule("MET-001"), max_cardinality=90)


def _strict_findings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Findings of the strict rule, and the largest violation of each."""
    rows = agg.metric_attribute_cardinality(t.points())
    catalogue = catalogue_frame(t.spark, [STRICT])
    results = rule_ops.rule_results(
        rule_ops.aggregate_rollup({"metric_attribute_cardinality": rows}, [STRICT]), catalogue)
    largest = scoring.largest_violations(rows, [STRICT], "metric_attribute_cardinality", "cardinality",
                                         ["metric", "attribute", "cardinality"])
    return scoring.findings(results, catalogue), largest


VIEWS["v_strict"] = """
select service, count(*) as observed, sum(case when cardinality < 90 then 0 else 1 end) as violations,
       max(cardinality) as top,
       first(metric order by cardinality desc, metric) as metric
from v_attr_cardinality group by service having max(cardinality) >= 90"""


@query("remediation_params", r"""
select service, 'MET-001' as rule_id, regexp_replace(service, '[^A-Za-z0-9_]', '_', 'g') as safe_service, metric,
       'k' as attribute, top::varchar as cardinality,
       round_even(violations / observed::double * 100, 0)::bigint::varchar || '%' as ratio_pct
from v_strict""")
def remediation_params(t: Tables) -> DataFrame:
    return scoring.remediation_params(*_strict_findings(t))


@query("price_findings", """
select service, 'MET-001' as rule_id, top::double as quantity, round(top / 1e6 * 8.0, 6) as estimated_monthly_cost
from v_strict""")
def price_findings(t: Tables) -> DataFrame:
    rates = spend_ops.Rates(per_gb=0.0, per_million_series=8.0)
    found, largest = _strict_findings(t)
    return spend_ops.price_findings(found, catalogue_frame(t.spark, [STRICT]), rates, largest).select(
        "service", "rule_id", "quantity", "estimated_monthly_cost")


# --- verification -----------------------------------------------------------------------------

VIEWS["v_presence"] = """
select distinct service, 'RES-005' as rule_id, true as passed, null::bigint as series from v_items
where service in (select job from v_jobs union select split_part(job, '/', -1) from v_jobs)"""
VIEWS["v_exact"] = """
select name as metric, 'k' as attribute, count(distinct attr_k) as series from v_metric_points group by name"""
VIEWS["v_verified_card"] = """
select f.service, 'MET-001' as rule_id, bool_and(e.series < 95) as passed, max(e.series) as series
from v_attr_cardinality f join v_exact e on e.metric = f.metric and e.attribute = f.attribute
where f.cardinality >= 90 and e.series > 0 group by f.service"""


def _services(t: Tables) -> DataFrame:
    return rule_ops._union([df.select("service") for df in t.signals().values()]).distinct()


def _verified_presence(t: Tables) -> DataFrame:
    return scoring.verify_presence(_services(t), t.jobs(), "RES-005")


def _verified_cardinality(t: Tables) -> DataFrame:
    rows = rule_ops.aggregate_verdicts(agg.metric_attribute_cardinality(t.points()), STRICT)
    exact = backend.label_cardinalities(t.backend_samples())
    return scoring.verify_cardinality(rows.where(~F.col("passed")), exact, "MET-001", 95)


@query("verify_presence", "select service, rule_id, passed from v_presence")
def verify_presence(t: Tables) -> DataFrame:
    return _verified_presence(t).select("service", "rule_id", "passed")


@query("verify_cardinality", "select service, rule_id, passed, series from v_verified_card")
def verify_cardinality(t: Tables) -> DataFrame:
    return _verified_cardinality(t)


@query("apply_verified", """
select coalesce(r.service, v.service) as service, coalesce(r.rule_id, v.rule_id) as rule_id,
       coalesce(r.observed, 0) as observed, round(coalesce(r.ratio, 0), 6) as ratio,
       coalesce(v.passed, r.passed) as passed,
       case when v.passed is not null then 'verified' else 'sampled' end as confidence, v.series as verified_series
from v_results r
full join (select * from v_presence union all select * from v_verified_card) v
  on v.service = r.service and v.rule_id = r.rule_id""")
def apply_verified(t: Tables) -> DataFrame:
    verified = _verified_presence(t).unionByName(_verified_cardinality(t))
    return Scoring(t.spark, t.signals(names=True), DEFAULT_RULES, verified).results.select(
        "service", "rule_id", "observed", "ratio", "passed", "confidence", "verified_series")


# --- graph, rules, stored findings ------------------------------------------------------------

@query("graph_nodes", """
select n.service, round(s.spec_score, 6) as spec_score, coalesce(s.findings, 0) as findings,
       round(coalesce(s.spec_score / 100, 0), 6) as score_part, round(coalesce(1 - s.spec_score / 100, 0), 6) as gap_part
from (select service from v_scores union select caller from v_edges union select callee from v_edges) n
left join v_scores s using (service)""")
def graph_nodes(t: Tables) -> DataFrame:
    s = _scoring(t)
    return scoring.graph_nodes(s.scores, s.edges)


@query("graph_edges", "select caller as source, callee as target, traces from v_edges")
def graph_edges(t: Tables) -> DataFrame:
    return scoring.graph_edges(traces.service_dependency(t.spans()))


@query("rules_merge", """
select service, rule_id, sum(case when passed then 0 else 1 end)::bigint as violations from (
  select service, 'MET-001' as rule_id, cardinality < 90 as passed from v_attr_cardinality
  union all select service, 'MET-004', cardinality <= 1 from v_bucket_signatures
  union all select service, 'TEAM-001', cardinality <= 50 from v_attr_cardinality) x group by service, rule_id""")
def merged_rules(t: Tables) -> DataFrame:
    from obsgauge.plans.catalogue import Rule, rule_from_row

    own = Rule("TEAM-001", "extension", "Attributes stay small", "metric", "low", "cardinality <= :limit",
               aggregate="metric_attribute_cardinality", params={"limit": 50})
    base = catalogue_frame(t.spark, [rule("MET-001"), rule("MET-004")])
    merged = rules_merge(base, catalogue_frame(t.spark, [STRICT, own]))
    rules = [rule_from_row(r) for r in merged.collect()]  # the catalogue: a row per rule
    frames = {n: AGGREGATES[n](t.signals()) for n in {r.aggregate for r in rules}}
    return rule_ops.aggregate_rollup(frames, rules).select("service", "rule_id", "violations")


_RESOURCE_RULES = ("RES-005", "EXT-RES-001", "EXT-RES-002", "EXT-RES-003")
VIEWS["v_dated_verdicts"] = "\nunion all ".join(
    [f"select '{r}' as rule_id, service, ts, ({_ITEM_SQL[r][1]}) as passed from (select *, {ver} as ver from {view})"
     for r in _RESOURCE_RULES for view, ver in (("v_logs", "null"), ("v_metric_points", "null"), ("v_spans", "service_version"))]
    + [f"select '{r}', service, ts, ({_ITEM_SQL[r][1]}) from {_ITEM_SQL[r][0]}"
       for r in ("SPA-004", "LOG-001", "LOG-002", "EXT-LOG-001", "MET-002", "MET-005", "EXT-MET-002")])
VIEWS["v_daily_ratios"] = """
select service, rule_id, sum(case when passed then 0 else 1 end) / count(*)::double as ratio
from v_dated_verdicts group by service, rule_id, date_trunc('day', ts)"""


def daily_findings(t: Tables) -> DataFrame:
    """Findings of all item rules over all signals, one scoring per day."""
    catalogue = catalogue_frame(t.spark, ITEM_RULES)
    signals = {name: df.withColumn("day", F.to_date("ts")) for name, df in t.signals(times=True).items()}
    rollup = rule_ops.item_rollup(signals, ITEM_RULES, keys=("day", "service"))
    return scoring.findings(rule_ops.rule_results(rollup, catalogue), catalogue)


@query("rule_ratio_history", """
select rule_id, round(ratio, 6) as ratio from v_daily_ratios join v_rules using (rule_id) where ratio > threshold_ratio""")
def rule_ratio_history(t: Tables) -> DataFrame:
    return snapshots.rule_ratio_history(daily_findings(t))


@query("user_rule", """
select service, count(*) as observed, sum(case when try_cast(attr_k as int) < 50 then 0 else 1 end)::bigint as violations,
       0::bigint as eval_errors
from v_metric_points group by service""")
def user_rule(t: Tables) -> DataFrame:
    """A rule written by a user, with a parameter and a cast that may fail."""
    from obsgauge.plans.catalogue import Rule, check_criteria

    own = Rule("TEAM-002", "extension", "Keys stay below a limit", "metric", "low",
               "try_cast(attrs['k'] as int) < :limit", params={"limit": 50})
    points = t.points()
    check_criteria(own, points)
    return rule_ops.item_rollup({"metric": points}, [own]).drop("rule_id")
