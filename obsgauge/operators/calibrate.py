"""Thresholds proposed from observed distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.ranks import robust_stats
from obsgauge.plans.catalogue import THRESHOLD_RATIO


def ceil_two_digits(value: Column) -> Column:
    """Smallest number with two significant digits that is not below ``value``."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(value)) - 1)
    return F.when(value <= 0, F.lit(0.0)).otherwise(F.ceil(value / unit) * unit)


def calibration_values(aggregates: DataFrame, ratios: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(rule_id, value) a rule's parameter is calibrated on.

    ``aggregates`` is the long form (service, aggregate, dims, fields);
    ``ratios`` holds (rule_id, ratio) of failing services.
    """
    wanted = catalogue.where(F.col("calibration").isNotNull()).select(
        "rule_id", F.col("calibration.source").alias("_source"), F.col("calibration.aggregate").alias("aggregate"),
        F.col("calibration.value").alias("_field"))
    from_rows = (aggregates.select("aggregate", "fields")
                 .join(wanted.where(F.col("_source") == "aggregate"), "aggregate")
                 .select("rule_id", F.col("fields")[F.col("_field")].alias("value")))
    from_ratios = (ratios.select("rule_id", F.col("ratio").alias("value"))
                   .join(wanted.where(F.col("_source") == "finding_ratio").select("rule_id"), "rule_id", "left_semi"))
    return from_rows.unionByName(from_ratios).where(F.col("value").isNotNull())


def propose_thresholds(aggregates: DataFrame, ratios: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per calibratable rule with data: current and proposed value and the distribution behind it."""
    stats = robust_stats(calibration_values(aggregates, ratios, catalogue), ["rule_id"], "value")
    cal = catalogue.where(F.col("calibration").isNotNull()).select(
        "rule_id", F.col("calibration.param").alias("param"), F.col("calibration.kind").alias("kind"),
        F.when(F.col("calibration.param") == THRESHOLD_RATIO, F.col("threshold_ratio"))
        .otherwise(F.coalesce(F.col("params")[F.col("calibration.param")].try_cast("double"), F.lit(0.0)))
        .alias("current"))
    p99 = F.col("p99")
    spread = F.greatest(F.lit(0.05), F.col("mad") * 2)
    proposed = (F.when(F.col("kind") == "count", ceil_two_digits(p99 * 2))
                .when(F.col("kind") == "small_count", F.ceil(p99) + 1)
                .when(F.col("kind") == "ratio", F.least(F.lit(1.0), F.floor((p99 + spread) * 100 + F.lit(0.5)) / 100)))
    return stats.join(cal, "rule_id").select(
        "rule_id", "param", "kind", "current", proposed.cast("double").alias("proposed"),
        "n", "median", "mad", "p90", "p99", "max")


def override_rules(catalogue: DataFrame, proposals: DataFrame) -> DataFrame:
    """Full copies of the proposed rules with the one parameter (or the roll-up threshold) replaced."""
    p = proposals.select("rule_id", F.col("param").alias("_param"), F.col("proposed").alias("_proposed"))
    ratio = F.col("_param") == THRESHOLD_RATIO
    text = F.when(F.col("_proposed") == F.floor("_proposed"), F.col("_proposed").cast("bigint").cast("string")
                  ).otherwise(F.col("_proposed").cast("string"))
    moved = F.map_from_entries(F.concat(
        F.filter(F.map_entries("params"), lambda e: e["key"] != F.col("_param")),
        F.array(F.struct(F.col("_param").alias("key"), text.alias("value")))))
    return (catalogue.join(p, "rule_id")
            .withColumn("params", F.when(ratio, F.col("params")).otherwise(moved))
            .withColumn("threshold_ratio", F.when(ratio, F.col("_proposed")).otherwise(F.col("threshold_ratio")))
            .select(*catalogue.columns))
