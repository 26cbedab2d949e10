"""Monthly cost of telemetry: pricing, storage, lifecycle savings and movement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgauge.operators.rules import _union

# Fixed values of the cost model.
HOURS_PER_MONTH = 730.0
BYTES_PER_GB = 1e9
SERIES_UNIT = 1e6
TRANSITIONS = (
    ("STANDARD", "STANDARD_IA"),
    ("STANDARD", "GLACIER_IR"),
    ("STANDARD", "GLACIER"),
    ("STANDARD", "DEEP_ARCHIVE"),
    ("STANDARD_IA", "GLACIER_IR"),
    ("GLACIER_IR", "GLACIER"),
    ("GLACIER", "DEEP_ARCHIVE"),
)


@dataclass(frozen=True)
class Rates:
    """Prices per month.  A few numbers, so they enter plans as literals."""

    per_gb: float
    per_million_series: float
    per_gb_by_signal: dict[str, float] = field(default_factory=dict)
    storage_gb_month: dict[str, float] = field(default_factory=dict)
    currency: str = "USD"

    def __post_init__(self) -> None:
        if not self.currency:
            raise ValueError("currency is required")
        values = {"per_gb": self.per_gb, "per_million_series": self.per_million_series,
                  **self.per_gb_by_signal, **self.storage_gb_month}
        for name, rate in values.items():
            if rate < 0:
                raise ValueError(f"{name}: {rate} is below zero")

    def ingest(self, signal: Column) -> Column:
        """Rate of the signal, else the default rate."""
        return _lookup(signal, self.per_gb_by_signal, F.lit(float(self.per_gb)))

    def storage(self, storage_class: Column) -> Column:
        """Rate of the class; NULL where the class is not priced."""
        return _lookup(storage_class, self.storage_gb_month, F.lit(None).cast("double"))


def _lookup(key: Column, table: dict[str, float], default: Column) -> Column:
    if not table:
        return default
    out = None
    for k, v in table.items():
        branch = (key == F.lit(k), F.lit(float(v)))
        out = F.when(*branch) if out is None else out.when(*branch)
    return out.otherwise(default)


def monthly_factor(window_s: float) -> float:
    """Measured window → month; a window that is not positive is not scaled."""
    return HOURS_PER_MONTH / (window_s / 3600.0) if window_s > 0 else 1.0


STREAM_COLUMNS = ("service", "team", "signal", "ingest_bytes", "active_series")


def gather_usage(series: DataFrame | None = None, log_bytes: DataFrame | None = None,
                 streams: DataFrame | None = None) -> DataFrame:
    """Usage of the sources at hand, tagged by signal.

    ``series``: (service, active_series); ``log_bytes``: (service, bytes);
    ``streams``: rows already in the common shape, which may carry a team and
    further signals.
    """
    zero, no_team = F.lit(0).cast("bigint"), F.lit("")
    parts = []
    if series is not None:
        parts.append(series.select("service", no_team.alias("team"), F.lit("metrics").alias("signal"),
                                   zero.alias("ingest_bytes"), F.col("active_series").cast("bigint")))
    if log_bytes is not None:
        parts.append(log_bytes.select("service", no_team.alias("team"), F.lit("logs").alias("signal"),
                                      F.col("bytes").cast("bigint").alias("ingest_bytes"),
                                      zero.alias("active_series")))
    if streams is not None:
        parts.append(streams.select("service", F.coalesce("team", no_team).alias("team"), "signal",
                                    F.col("ingest_bytes").cast("bigint"), F.col("active_series").cast("bigint")))
    if not parts:
        raise ValueError("no usage source given")
    return _union(parts)


def price_lines(usage: DataFrame, rates: Rates, window_s: float) -> DataFrame:
    """Cost per (service, team, signal).

    Bytes and series are summed as integers first, so the result does not
    depend on the order of rows; only bytes are scaled to a month.
    """
    gb = F.col("_bytes") / F.lit(BYTES_PER_GB)
    return (usage.groupBy("service", "team", "signal")
            .agg(F.sum("ingest_bytes").alias("_bytes"), F.sum("active_series").alias("_series"))
            .select("service", "team", "signal",
                    (gb * rates.ingest(F.col("signal")) * F.lit(monthly_factor(window_s))).alias("ingest_monthly"),
                    (F.col("_series") / F.lit(SERIES_UNIT) * F.lit(float(rates.per_million_series)))
                    .alias("active_series_monthly"))
            .withColumn("total_monthly", F.col("ingest_monthly") + F.col("active_series_monthly")))


def price_storage(stored: DataFrame, rates: Rates) -> DataFrame:
    """Cost per storage class from (storage_class, bytes); an unpriced class costs 0."""
    gb = F.sum("bytes") / F.lit(BYTES_PER_GB)
    return (stored.groupBy("storage_class").agg(gb.alias("gb"))
            .withColumn("monthly", F.col("gb") * F.coalesce(rates.storage(F.col("storage_class")), F.lit(0.0))))


def total_monthly(lines: DataFrame, storage: DataFrame) -> DataFrame:
    costs = lines.select(F.col("total_monthly").alias("_m")).unionByName(storage.select(F.col("monthly").alias("_m")))
    return costs.agg(F.coalesce(F.sum("_m"), F.lit(0.0)).alias("total_monthly"))


def budget_gate(total: DataFrame, limit: float) -> DataFrame:
    """Is the total above the limit?  A limit of 0 switches the gate off."""
    return total.select("total_monthly", (F.lit(limit > 0) & (F.col("total_monthly") > limit)).alias("over_budget"))


def lifecycle_savings(stored: DataFrame, rates: Rates,
                      transitions: Sequence[tuple[str, str]] = TRANSITIONS) -> DataFrame:
    """What moving a class to a strictly cheaper one would save, where both are priced."""
    moves = {src: [dst for s, dst in transitions if s == src] for src, _ in transitions}
    options = None
    for src, targets in moves.items():
        branch = (F.col("storage_class") == src, F.array(*[F.lit(t) for t in targets]))
        options = F.when(*branch) if options is None else options.when(*branch)
    df = (stored.groupBy("storage_class").agg(F.sum("bytes").alias("_bytes"))
          .where(F.col("_bytes") != 0)
          .select(F.col("storage_class").alias("from_class"), (F.col("_bytes") / F.lit(BYTES_PER_GB)).alias("gb"),
                  F.explode(options).alias("to_class")))
    now, after = rates.storage(F.col("from_class")), rates.storage(F.col("to_class"))
    return (df.where(after < now)
            .select("from_class", "to_class", "gb", (F.col("gb") * now).alias("current_monthly"),
                    (F.col("gb") * after).alias("projected_monthly"))
            .withColumn("savings_monthly", F.col("current_monthly") - F.col("projected_monthly")))


def cost_trend(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Movement per line against an earlier report; a missing side counts as 0."""
    keys = ["service", "team", "signal"]
    cur = current.groupBy(*keys).agg(F.sum("total_monthly").alias("_c"))
    prev = previous.groupBy(*keys).agg(F.sum("total_monthly").alias("_p"))
    delta = F.col("current") - F.col("previous")
    return (cur.join(prev, keys, "full")
            .select(*keys, F.coalesce("_c", F.lit(0.0)).alias("current"), F.coalesce("_p", F.lit(0.0)).alias("previous"))
            .withColumn("delta", delta)
            .withColumn("percent_delta",
                        F.when(F.col("previous") > 0, delta / F.col("previous") * 100).otherwise(F.lit(0.0))))


def trend_total(current_total: DataFrame, previous_total: DataFrame) -> DataFrame:
    """Movement of the total, storage included; both inputs are one row."""
    signed = current_total.select(F.col("total_monthly").alias("_m")).unionByName(
        previous_total.select((-F.col("total_monthly")).alias("_m")))
    return signed.agg(F.sum("_m").alias("total_delta"))


def price_findings(found: DataFrame, catalogue: DataFrame, rates: Rates, largest: DataFrame) -> DataFrame:
    """Monthly estimate per finding; NULL where the rule has no cost driver or no quantity is known.

    The quantity is the verified count if there is one, else that of the largest of all
    violations: ``largest`` holds (service, rule_id, quantity).
    """
    drivers = catalogue.where(F.col("cost_quantity").isNotNull()).select("rule_id", "cost_quantity")
    verified = F.col("verified_series").cast("double") if "verified_series" in found.columns \
        else F.lit(None).cast("double")
    quantity = F.when(F.col("cost_quantity").isNotNull(), F.coalesce(verified, F.col("_seen")))
    seen = largest.select("service", "rule_id", F.col("quantity").alias("_seen"))
    return (found.join(drivers, "rule_id", "left").join(seen, ["service", "rule_id"], "left")
            .withColumn("quantity", quantity)
            .withColumn("estimated_monthly_cost",
                        F.col("quantity") / F.lit(SERIES_UNIT) * F.lit(float(rates.per_million_series)))
            .drop("cost_quantity", "_seen"))


def cost_report(spark: SparkSession, lines: DataFrame, storage: DataFrame, taken_at) -> DataFrame:
    """Lines and storage of one report in one table, the shape snapshots are stored in."""
    at = F.lit(taken_at).cast("timestamp").alias("taken_at")
    none = F.lit(None).cast("string")
    return _union([
        lines.select(at, F.lit("line").alias("part"), "service", "team", "signal", none.alias("storage_class"),
                     "ingest_monthly", "active_series_monthly", "total_monthly"),
        storage.select(at, F.lit("storage").alias("part"), none.alias("service"), none.alias("team"),
                       none.alias("signal"), "storage_class", F.lit(0.0).alias("ingest_monthly"),
                       F.lit(0.0).alias("active_series_monthly"), F.col("monthly").alias("total_monthly"))])
