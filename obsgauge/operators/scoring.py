"""Scores, findings, verification and the service graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.functions.attributes import job_services, present, safe_label, score_category
from obsgauge.functions.timebins import bin_of
from obsgauge.operators.rules import _union, item_rollup
from obsgauge.plans.catalogue import Rule

# What stands in for a missing patch value.
METRIC_PLACEHOLDER = "REPLACE_WITH_METRIC_NAME"
ATTRIBUTE_PLACEHOLDER = "REPLACE_WITH_ATTRIBUTE_KEY"


def _score(where: Column | None = None) -> Column:
    """Passed weight over weight, in percent; NULL if no rule took part."""
    weight = F.col("weight").cast("double")
    if where is not None:
        weight = F.when(where, weight)
    return F.sum(F.when(F.col("passed"), weight).otherwise(weight * 0)) / F.sum(weight) * 100


def service_scores(results: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Spec and extension score per service, never blended.

    A service without spec rules scores 100; its extension score is NULL when
    no extension rule ran.  ``services`` adds services without any result.
    """
    scored = results.groupBy("service").agg(
        _score(F.col("source") == "spec").alias("_spec"),
        _score(F.col("source") == "extension").alias("extension_score"),
        F.count_if(~F.col("passed")).alias("findings"))
    if services is not None:
        scored = services.select("service").distinct().join(scored, "service", "full")
    return scored.select(
        "service", F.coalesce("_spec", F.lit(100.0)).alias("spec_score"),
        score_category(F.coalesce("_spec", F.lit(100.0))).alias("category"),
        "extension_score", F.coalesce("findings", F.lit(0)).alias("findings"))


def fleet_score(scores: DataFrame) -> DataFrame:
    """Plain mean over services; an empty fleet scores 100 and says so in ``services``."""
    return scores.agg(F.coalesce(F.avg("spec_score"), F.lit(100.0)).alias("fleet_score"),
                      F.count(F.lit(1)).alias("services"))


def score_gate(scores: DataFrame, minimum: float) -> DataFrame:
    """Is the fleet below the limit?  An empty fleet is flagged, not waved through."""
    return fleet_score(scores).select(
        "fleet_score", "services", (F.col("fleet_score") < minimum).alias("below"),
        (F.col("services") == 0).alias("empty_fleet"))


def worst_first(scores: DataFrame) -> DataFrame:
    """The whole fleet with its place; one row a service is numbered."""
    return scores.withColumn("place", F.row_number().over(Window.orderBy("spec_score", "service")).cast("bigint")).orderBy("place")


def findings(results: DataFrame, catalogue: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row per failed (service, rule), with its counts, texts and evidence."""
    texts = catalogue.select("rule_id", F.col("name").alias("rule_name"), "target", "template")
    out = results.where(~F.col("passed")).join(texts, "rule_id")
    if evidence is not None:
        out = out.join(evidence, ["service", "rule_id"], "left")
    return out


def finding_counts(found: DataFrame) -> DataFrame:
    """Services hit per rule."""
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("services"))


def findings_by_impact(found: DataFrame) -> DataFrame:
    return found.groupBy("service", "impact").agg(F.count(F.lit(1)).alias("findings"))


def rules_evaluated(catalogue: DataFrame, results: DataFrame) -> DataFrame:
    """(rule_id, services): every loaded rule with the services it was judged for, 0 where it found nothing to judge."""
    judged = results.groupBy("rule_id").agg(F.count(F.lit(1)).alias("services"))
    return catalogue.select("rule_id").join(judged, "rule_id", "left").select("rule_id", F.coalesce("services", F.lit(0)).alias("services"))


def score_gauges(scores: DataFrame, found: DataFrame) -> DataFrame:
    """Current gauges in long form: score per service, fleet score, findings per impact."""

    def gauge(df: DataFrame, name: str, service, impact, value) -> DataFrame:
        return df.select(F.lit(name).alias("gauge"), service.cast("string").alias("service"),
                         impact.cast("string").alias("impact"), value.cast("double").alias("value"))

    none = F.lit(None)
    return _union([
        gauge(scores, "service_score", F.col("service"), none, F.col("spec_score")),
        gauge(fleet_score(scores), "fleet_score", none, none, F.col("fleet_score")),
        gauge(findings_by_impact(found), "findings", F.col("service"), F.col("impact"), F.col("findings")),
    ])


# --- evidence -------------------------------------------------------------------------------

_SUMMARY = {
    "span": lambda: (F.concat(F.lit("span "), F.col("name")), F.col("resource")),
    "metric": lambda: (F.concat(F.lit("metric "), F.col("name")), F.col("attrs")),
    "log": lambda: (F.concat(F.lit("log severity="), F.coalesce("severity_text", F.lit(""))), F.col("resource")),
}
_KIND = {"span": "span", "metric": "metric_point", "log": "log_record"}


def _keep(violations: DataFrame, order: Sequence[Column], k: int | None) -> DataFrame:
    """k rows per (service, rule) in the given order; all of them without k.

    The filter on row_number lets Spark keep only k rows per key on the map
    side (WindowGroupLimit), so the shuffle carries k rows per key and task.
    """
    w = Window.partitionBy("service", "rule_id").orderBy(*order)
    ranked = violations.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def item_violations(signals: Mapping[str, DataFrame], rules: Sequence[Rule], item_id: str = "item_id") -> DataFrame:
    """One row per violating item and rule, with its evidence fields."""
    parts = []
    for signal, df in signals.items():
        due = [r for r in rules if r.applies_to(signal)]
        if not due:
            continue
        failed = F.array_compact(F.array(*[
            F.when(~F.coalesce(r.expression(), F.lit(True)), F.lit(r.rule_id)) for r in due]))
        summary, attrs = _SUMMARY[signal]()
        parts.append(df.select("service", "ts", F.col(item_id).cast("string").alias("item_id"),
                               F.lit(_KIND[signal]).alias("kind"), summary.alias("summary"),
                               attrs.alias("attrs"), failed.alias("_failed"))
                     .where(F.size("_failed") > 0)
                     .withColumn("rule_id", F.explode("_failed")).drop("_failed"))
    return _union(parts)


def _evidence_bin(bin_s: int) -> Column:
    """Time bin of an item; items without a time come first, as in the order of evidence."""
    return F.coalesce(bin_of(F.col("ts"), bin_s), F.lit(-1 << 62))


def _first_bins(signals: Mapping[str, DataFrame], rules: Sequence[Rule], k: int, bin_s: int) -> DataFrame:
    """(service, rule, time bin) that can hold one of the first k violations of its service and rule."""
    binned = {name: df.withColumn("_bin", _evidence_bin(bin_s)) for name, df in signals.items()}
    counts = item_rollup(binned, rules, keys=("service", "_bin")).where(F.col("violations") > 0)
    upto = Window.partitionBy("service", "rule_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("violations").over(upto) - F.col("violations")
    return counts.withColumn("_before", before).where(F.col("_before") < k).select("service", "rule_id", "_bin")


def item_evidence(signals: Mapping[str, DataFrame], rules: Sequence[Rule], k: int | None,
                  bin_s: int | None = 86400) -> DataFrame:
    """First k violating items per (service, rule), a listing; ``None``: all of them.

    A count per time bin comes first and leaves only the bins the first k can
    lie in, so just their violations are ordered instead of all of them.
    ``bin_s=None`` orders everything, which is enough for short histories.
    """
    found = item_violations(signals, rules)
    if bin_s is not None and k is not None:
        found = found.withColumn("_bin", _evidence_bin(bin_s)).join(
            _first_bins(signals, rules, k, bin_s), ["service", "rule_id", "_bin"], "left_semi").drop("_bin")
    return _keep(found, [F.col("ts"), F.col("kind"), F.length("item_id"), F.col("item_id")], k)


def aggregate_evidence(rows: DataFrame, rules: Sequence[Rule], aggregate: str, order: Sequence[str],
                       k: int | None) -> DataFrame:
    """Latest k violating aggregate rows per (service, rule), a listing; ``order`` names the time, then tie-breakers.

    ``k`` shortens the listing only; ``None`` gives all.  Quantities come from ``largest_violations``.
    """
    return _keep(aggregate_violations(rows, rules, aggregate), [F.col(order[0]).desc(), *[F.col(c) for c in order[1:]]], k)


def aggregate_violations(rows: DataFrame, rules: Sequence[Rule], aggregate: str) -> DataFrame:
    """Every (aggregate row, violated rule)."""
    due = [r for r in rules if r.aggregate == aggregate]
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(r.expression(), F.lit(False)), F.lit(r.rule_id)) for r in due]))
    return rows.withColumn("rule_id", F.explode(failed))


def largest_violations(rows: DataFrame, rules: Sequence[Rule], aggregate: str, by: str, fields: Sequence[str]) -> DataFrame:
    """(service, rule_id, quantity, fields): the violating row with the largest ``by``, of all of them.

    Among equal ones the row with the first fields counts.
    """
    top = F.min_by(F.struct(*fields), F.struct(-F.col(by).cast("double"), *[F.col(f) for f in fields]))
    return (aggregate_violations(rows, rules, aggregate).groupBy("service", "rule_id")
            .agg(F.max(F.col(by).cast("double")).alias("quantity"), top.alias("_top"))
            .select("service", "rule_id", "quantity", "_top.*"))


def evidence_lists(kept: DataFrame) -> DataFrame:
    """Evidence as an array of at most k entries per (service, rule)."""
    seen = F.map_filter("attrs", lambda _k, v: v.isNotNull())  # an attribute without value was not sent
    entry = F.struct("rank", "kind", "summary", seen.alias("attrs"))
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"])
    return kept.groupBy("service", "rule_id").agg(
        F.transform(ordered, lambda e: F.struct(e["kind"].alias("kind"), e["summary"].alias("summary"),
                                                e["attrs"].alias("attrs"))).alias("evidence"))


def fields_evidence(kept: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Aggregate rows in the shape ``evidence_lists`` takes: fields become attributes."""
    flat = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    return kept.select("service", "rule_id", "rank", F.lit("aggregate").alias("kind"),
                       F.lit("").alias("summary"), F.create_map(*flat).alias("attrs"))


# --- verification against an unsampled backend ------------------------------------------------

def verify_presence(services: DataFrame, jobs: DataFrame, rule_id: str) -> DataFrame:
    """Services a backend job stands for pass; absence proves nothing."""
    known = jobs.select(F.explode(job_services(F.col("job"))).alias("service"))
    return (services.select("service").distinct().join(known, "service", "left_semi")
            .select("service", F.lit(rule_id).alias("rule_id"), F.lit(True).alias("passed"),
                    F.lit(None).cast("bigint").alias("series")))


def verify_cardinality(flagged: DataFrame, exact: DataFrame, rule_id: str, maximum: int) -> DataFrame:
    """Flagged (service, metric, attribute) pairs re-counted on unsampled data.

    ``exact`` holds (metric, attribute, series).  A pair the backend does not
    know leaves the sampled verdict alone.  A service passes only if all of
    its known pairs do; ``series`` is its largest count.
    """
    known = exact.where(F.col("series") > 0)
    return (flagged.select("service", "metric", "attribute").distinct()
            .join(known, ["metric", "attribute"])
            .groupBy("service").agg(F.min(F.col("series") < maximum).alias("passed"),
                                    F.max("series").alias("series"))
            .select("service", F.lit(rule_id).alias("rule_id"), "passed", "series"))


def apply_verified(results: DataFrame, verified: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Verified verdicts replace sampled ones; services only the backend knows are added."""
    sampled = results.select("service", "rule_id", "observed", "violations", "eval_errors", "ratio",
                             F.col("passed").alias("_sampled"))
    facts = catalogue.select("rule_id", "source", "impact", "weight", "threshold_ratio")
    zero = F.lit(0).cast("bigint")
    return (sampled.join(verified.select("service", "rule_id", F.col("passed").alias("_verified"),
                                         F.col("series").alias("verified_series")),
                         ["service", "rule_id"], "full")
            .join(facts, "rule_id")
            .select("service", "rule_id", "source", "impact", "weight", "threshold_ratio",
                    F.coalesce("observed", zero).alias("observed"),
                    F.coalesce("violations", zero).alias("violations"),
                    F.coalesce("eval_errors", zero).alias("eval_errors"),
                    F.coalesce("ratio", F.lit(0.0)).alias("ratio"),
                    F.coalesce("_verified", "_sampled").alias("passed"),
                    F.when(F.col("_verified").isNotNull(), "verified").otherwise("sampled").alias("confidence"),
                    "verified_series"))


# --- service graph ----------------------------------------------------------------------------

def graph_nodes(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Scored services and edge ends; unscored ones have a NULL score.

    ``score_part`` and ``gap_part`` are the shares a node is drawn with, both
    0 when unscored.
    """
    none = F.lit(None)
    ends = edges.select(F.explode(F.array("caller", "callee")).alias("service"),
                        none.cast("double").alias("spec_score"), none.cast("bigint").alias("findings"))
    scored = scores.select("service", "spec_score", F.col("findings").cast("bigint").alias("findings"))
    share = F.col("spec_score") / 100
    # A scored service has one row with a score; edge ends only add names, so the fleet is scored once.
    nodes = scored.unionByName(ends).groupBy("service").agg(F.max("spec_score").alias("spec_score"), F.max("findings").alias("findings"))
    return nodes.select(
        "service", "spec_score", F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce(share, F.lit(0.0)).alias("score_part"),
        F.coalesce(1 - share, F.lit(0.0)).alias("gap_part"))


def graph_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("caller").alias("source"), F.col("callee").alias("target"), "traces")


# --- remediation parameters -------------------------------------------------------------------

def remediation_params(found: DataFrame, largest: DataFrame) -> DataFrame:
    """Values a patch for a finding needs, from its largest violation (``largest_violations`` with metric, attribute, cardinality)."""
    worst = largest.select("service", "rule_id", F.struct(
        "metric", "attribute", F.col("cardinality").cast("string").alias("cardinality")).alias("_a"))
    df = found.join(worst, ["service", "rule_id"], "left")

    def attr(name: str, placeholder: str, also: Column | None = None) -> Column:
        value = F.col("_a")[name]
        ok = present(value) if also is None else present(value) & also
        return F.when(ok, value).otherwise(F.lit(placeholder))

    whole = F.bround(F.col("_a")["cardinality"].try_cast("double"), 0).cast("bigint").cast("string")
    percent = F.concat(F.bround(F.col("ratio") * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    return df.select(
        "service", "rule_id", safe_label(F.col("service")).alias("safe_service"),
        attr("metric", METRIC_PLACEHOLDER).alias("metric"),
        attr("attribute", ATTRIBUTE_PLACEHOLDER,
             F.coalesce(F.col("_a")["attribute"] != "span.name", F.lit(True))).alias("attribute"),
        F.coalesce(whole, F.lit("")).alias("cardinality"),
        F.when(F.col("ratio") > 0, percent).otherwise(F.lit("")).alias("ratio_pct"))
