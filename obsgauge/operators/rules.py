"""Evaluation of item and aggregate rules and their roll-up per service.

All rules of a signal are judged in one pass over its table: one boolean
column per rule, counted with map-side combine, turned into rows only after
the aggregation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.plans.catalogue import Rule

ROLLUP_COLUMNS = ("rule_id", "observed", "violations", "eval_errors")


def evaluate(df: DataFrame, rule: Rule, name: str = "passed") -> DataFrame:
    """Verdict of one rule per row; NULL marks an evaluation error."""
    return df.withColumn(name, rule.expression())


def aggregate_verdicts(rows: DataFrame, rule: Rule) -> DataFrame:
    """Verdict of an aggregate rule per row; an evaluation error counts as a violation."""
    return rows.withColumn("passed", F.coalesce(rule.expression(), F.lit(False)))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _counts(df: DataFrame, rules: Sequence[Rule], keys: Sequence[str], errors_violate: bool) -> DataFrame:
    aggs: list[Column] = [F.count(F.lit(1)).alias("_n")]
    rows: list[Column] = []
    for i, r in enumerate(rules):
        verdict = r.expression()
        failed = ~F.coalesce(verdict, F.lit(False)) if errors_violate else ~F.coalesce(verdict, F.lit(True))
        aggs += [F.count_if(failed).alias(f"_v{i}"), F.count_if(verdict.isNull()).alias(f"_e{i}")]
        rows.append(F.struct(F.lit(r.rule_id).alias("rule_id"), F.col("_n").alias("observed"),
                             F.col(f"_v{i}").alias("violations"), F.col(f"_e{i}").alias("eval_errors")))
    return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))


def item_rollup(signals: Mapping[str, DataFrame], rules: Iterable[Rule],
                keys: Sequence[str] = ("service",)) -> DataFrame:
    """Observed items, violations and errors per (service, item rule).

    ``signals`` maps span, metric and log to their tables.  A rule that never
    applied to a service has no row for it.
    """
    rules = list(rules)
    parts = []
    for signal, df in signals.items():
        due = [r for r in rules if r.applies_to(signal)]
        if due:
            parts.append(_counts(df, due, keys, errors_violate=False))
    if not parts:
        raise ValueError("no item rule applies to the given signals")
    total = _union(parts)
    if len(parts) == 1:
        return total
    return total.groupBy(*keys, "rule_id").agg(
        *[F.sum(c).alias(c) for c in ROLLUP_COLUMNS[1:]])


def aggregate_rollup(aggregates: Mapping[str, DataFrame], rules: Iterable[Rule],
                     keys: Sequence[str] = ("service",)) -> DataFrame:
    """Judged rows and violations per (service, aggregate rule)."""
    rules = [r for r in rules if r.aggregate]
    parts = [_counts(rows, due, keys, errors_violate=True)
             for name, rows in aggregates.items()
             if (due := [r for r in rules if r.aggregate == name])]
    if not parts:
        raise ValueError("no aggregate rule applies to the given aggregates")
    return _union(parts)


def rule_results(rollup: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Ratio and verdict per (service, rule): pass while the ratio stays within the threshold."""
    ratio = F.when(F.col("observed") > 0, F.col("violations") / F.col("observed")).otherwise(F.lit(0.0))
    facts = catalogue.select("rule_id", "source", "impact", "weight", "threshold_ratio")
    return (rollup.join(facts, "rule_id")
            .withColumn("ratio", ratio)
            .withColumn("passed", F.col("ratio") <= F.col("threshold_ratio"))
            .withColumn("confidence", F.lit("sampled")))
