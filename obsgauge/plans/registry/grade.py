"""Registered queries: diagnoses graded against labelled root causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.operators import grading
from obsgauge.plans.registry.base import VIEWS, query
from obsgauge.sources.tables import Tables

VIEWS["v_breakdown"] = """
select coalesce(t.scenario, d.scenario) as scenario, coalesce(t.entity, d.entity) as entity,
       case when t.entity is not null and d.entity is not null then 'matched' when t.entity is not null then 'missed' else 'extra' end as verdict
from v_truth t full join v_diagnosis d on t.scenario = d.scenario and t.entity = d.entity"""
VIEWS["v_entity_scores"] = """
select scenario, count(*) filter (verdict = 'matched') as matched, count(*) filter (verdict = 'missed') as missed,
       count(*) filter (verdict = 'extra') as extra, count(*) as total from v_breakdown group by scenario"""
VIEWS["v_runs"] = """
select o_orderpriority as agent, o_orderkey as scenario, o_custkey % 50 as tool_calls, floor(o_totalprice)::bigint as tokens,
       s.matched / s.total::double as entity_score,
       lower(o_orderstatus) = case when o_totalprice > 150000 then 'f' else 'o' end as category_match,
       case when s.scenario is null and o_orderstatus <> 'P' then E'no answer\ndetail ' || o_orderstatus else '' end as error,
       s.scenario is null and o_orderstatus = 'P' as budget_exhausted,
       case o_orderstatus when 'P' then 'judge' when 'F' then 'json' else '' end as normalization
from orders left join v_entity_scores s on s.scenario = o_orderkey"""


def runs(t: Tables) -> DataFrame:
    """One diagnosis run per order; an order without graded entities gave no diagnosis."""
    graded = grading.entity_score(t.truth(), t.diagnosis()).select("scenario", "entity_score")
    orders = t.read("orders")
    failed, status = F.col("entity_score").isNull(), F.col("o_orderstatus")
    return (orders.join(graded, orders.o_orderkey == graded.scenario, "left").select(
        F.col("o_orderpriority").alias("agent"), F.col("o_orderkey").alias("scenario"),
        (F.col("o_custkey") % 50).alias("tool_calls"), F.floor("o_totalprice").alias("tokens"), "entity_score",
        grading.category_match(status, F.when(F.col("o_totalprice") > 150000, " f").otherwise("O ")).alias("category_match"),
        F.when(failed & (status != "P"), F.concat(F.lit("no answer\ndetail "), status)).otherwise("").alias("error"),
        (failed & (status == "P")).alias("budget_exhausted"),
        F.when(status == "P", "judge").when(status == "F", "json").otherwise("").alias("normalization")))


@query("entity_breakdown", "select scenario, entity, verdict from v_breakdown")
def entity_breakdown(t: Tables) -> DataFrame:
    return grading.entity_breakdown(t.truth(), t.diagnosis())


@query("entity_jaccard", """
select scenario, matched, missed, extra, round(matched / total::double, 6) as entity_score from v_entity_scores""")
def entity_jaccard(t: Tables) -> DataFrame:
    return grading.entity_score(t.truth(), t.diagnosis())


@query("entity_exact", "select scenario, case when matched = total then 1.0 else 0.0 end::double as entity_score from v_entity_scores")
def entity_exact(t: Tables) -> DataFrame:
    return grading.entity_score(t.truth(), t.diagnosis(), match="exact").select("scenario", "entity_score")


@query("category_match", "select category_match, count(*) as runs from v_runs group by category_match")
def category_match(t: Tables) -> DataFrame:
    return runs(t).groupBy("category_match").agg(F.count(F.lit(1)).alias("runs"))


@query("bench_summary", """
select agent, count(*) as attempts, count(entity_score) as diagnoses, count(*) - count(entity_score) as failures,
       count(*) filter (budget_exhausted) as budget_exhausted, round(avg(entity_score), 6) as mean_entity_score,
       round(stddev_pop(entity_score), 6) as stddev_entity_score,
       round(avg(case when entity_score is not null then category_match::int end), 6) as category_match_rate,
       round(avg(tool_calls), 6) as mean_tool_calls, round(avg(tokens), 6) as mean_tokens
from v_runs group by agent""")
def bench_summary(t: Tables) -> DataFrame:
    return grading.run_summary(runs(t), ["agent"])


@query("run_outcome", r"""
select agent, case when budget_exhausted then 'budget exhausted' when error <> '' then 'error: ' || error
       else 'diagnosed' end as outcome, count(*) as runs from v_runs group by 1, 2""")
def run_outcome(t: Tables) -> DataFrame:
    return grading.run_outcomes(runs(t)).groupBy("agent", "outcome").agg(F.count(F.lit(1)).alias("runs"))


@query("most_missed", """
select entity, count(*) as missed from v_breakdown where verdict = 'missed'
and scenario in (select scenario from v_runs where entity_score is not null) group by entity""")
def most_missed(t: Tables) -> DataFrame:
    return grading.most_missed(grading.entity_breakdown(t.truth(), t.diagnosis()),
                               runs(t).where(F.col("entity_score").isNotNull()))


@query("normalization_methods", "select distinct agent, normalization from v_runs where normalization <> ''")
def normalization_methods(t: Tables) -> DataFrame:
    return grading.normalization_methods(runs(t), ["agent"])


@query("scenario_hash", """
select o_orderkey as scenario, sha256('{"name":"order-' || o_orderkey || '","category":"' || o_orderpriority
       || '","customer":' || o_custkey || '}') as digest from orders""")
def scenario_hash(t: Tables) -> DataFrame:
    document = F.struct(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"),
                        F.col("o_orderpriority").alias("category"), F.col("o_custkey").alias("customer"))
    return t.read("orders").select(F.col("o_orderkey").alias("scenario"),
                                   grading.scenario_hash(document).alias("digest"))


@query("extract_json", r"""
select conv_id, turn, md5('{"role":"' || role || '","turn":{"n":' || turn || '}}') as digest from conversations""")
def extract_json(t: Tables) -> DataFrame:
    """Replies in three wrappings: fenced with a tag, fenced without, and inside prose."""
    document = F.concat(F.lit('{"role":"'), F.col("role"), F.lit('","turn":{"n":'), F.col("turn").cast("string"), F.lit("}}"))
    tagged = F.concat(F.col("text"), F.lit("\n```json\n"), document, F.lit("\n```\nthat is all {really}"))
    bare = F.concat(F.lit("```"), document, F.lit("```"), F.col("text"))
    prose = F.concat(F.col("text"), F.lit(" answer: "), document, F.lit(" as said"))
    reply = F.when(F.col("role") == "user", tagged).when(F.col("role") == "system", bare).otherwise(prose)
    return t.read("conversations").select("conv_id", "turn", F.md5(grading.extract_json(reply)).alias("digest"))


@query("normalize_diagnosis", """
select case when role = 'system' then 'missing:category' when turn % 5 = 1 then 'extra:guess'
            when turn % 5 = 2 then 'range:confidence' when turn % 5 = 3 then 'missing:entities'
            when length(text) % 3 = 1 then 'type:confidence' when length(text) % 3 = 2 then 'type:root_cause_entities[]' end as reject,
       case when role <> 'system' and turn % 5 in (0, 4) and length(text) % 3 = 0 then role end as category, count(*) as answers
from conversations group by 1, 2""")
def normalize_diagnosis(t: Tables) -> DataFrame:
    """One answer per conversation turn, some of them faulty in a known way."""
    kind, size = F.col("turn") % 5, F.char_length("text") % 3
    typed = kind.isin(0, 4) & (F.col("role") != "system")
    category = F.when(F.col("role") == "system", " ").otherwise(F.col("role"))
    raw = F.concat(
        F.lit('{"scenario":"made up","category":"'), category, F.lit('"'),
        F.when((kind == 1) & (F.col("role") != "system"), ',"guess":1').otherwise(""),
        F.when(kind == 2, ',"confidence":1.5').when(typed & (size == 1), ',"confidence":"0.5"').otherwise(',"confidence":0.5'),
        F.when(kind == 3, ',"root_cause_entities":[]').when(typed & (size == 2), ',"root_cause_entities":[{"kind":1,"name":"cart"}]').otherwise(
            ',"root_cause_entities":[{"kind":"Deployment","namespace":"shop","name":"cart"}]'), F.lit("}"))
    df = t.read("conversations").select(F.col("conv_id").cast("string").alias("scenario"), raw.alias("raw"))
    return grading.normalize_diagnosis(df).groupBy("reject", "category").agg(F.count(F.lit(1)).alias("answers"))
