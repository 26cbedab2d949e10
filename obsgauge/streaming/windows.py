"""Streaming roll-up and cardinality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.operators.rules import _union
from obsgauge.plans.catalogue import Rule


def stream_rule_rollup(signals: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Growing counters per (service, item rule) over all signals; update or complete mode.

    The signals are brought to one shape first, so one stateful aggregation
    serves all of them and its state is one row per service.
    """
    due = [r for r in rules if any(r.applies_to(s) for s in signals)]
    parts = []
    for signal, df in signals.items():
        cols = [F.col("service")]
        for i, r in enumerate(due):
            if r.applies_to(signal):
                verdict = r.expression()
                cols += [F.lit(1).alias(f"o{i}"), (~F.coalesce(verdict, F.lit(True))).cast("int").alias(f"v{i}"),
                         verdict.isNull().cast("int").alias(f"e{i}")]
            else:
                cols += [F.lit(0).alias(f"{c}{i}") for c in "ove"]
        parts.append(df.select(*cols))
    sums = [F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(len(due)) for c in "ove"]
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(f"o{i}").alias("observed"),
                              F.col(f"v{i}").alias("violations"), F.col(f"e{i}").alias("eval_errors"))
                     for i, r in enumerate(due)])
    return (_union(parts).groupBy("service").agg(*sums).select("service", F.inline(rows))
            .where(F.col("observed") > 0))


def stream_cardinality(values: DataFrame, keys: Sequence[str], value: str = "value", window: str = "1 hour",
                       delay: str = "10 minutes", rsd: float = 0.02) -> DataFrame:
    """Distinct values per key and tumbling window, emitted when the window closes (append mode).

    State per key and window is one fixed-size sketch.  What is written are estimates, which cannot be
    merged; ``stream_cardinality_sketches`` writes the sketches.
    """
    return (values.withWatermark("ts", delay)
            .groupBy(F.window("ts", window), *keys)
            .agg(F.approx_count_distinct(value, rsd).alias("cardinality"))
            .select(*keys, F.col("window.start").alias("window_start"), "cardinality"))


def stream_cardinality_sketches(values: DataFrame, keys: Sequence[str], value: str = "value", window: str = "1 hour",
                                delay: str = "10 minutes", lg_k: int = 12) -> DataFrame:
    """(keys, window_start, sketch, cardinality) of closed windows (append mode): the state is the stored column.

    ``two_generations`` merges the written sketches; ``merge_sketches`` rolls them up to coarser keys or longer
    windows.  A window's state goes when it closes, so a key that falls silent leaves nothing behind.
    """
    return (values.withWatermark("ts", delay)
            .groupBy(F.window("ts", window), *keys)
            .agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))
            .select(*keys, F.col("window.start").alias("window_start"), "sketch", F.hll_sketch_estimate("sketch").alias("cardinality")))
