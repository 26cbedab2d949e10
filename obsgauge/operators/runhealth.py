"""Health of long collector runs: continuity, memory, throughput, distributions.

Samples are (run, ts, rss, pairs, evictions, items): one row per sampling
tick.  Neighbouring samples are compared inside fixed time blocks; only the
last sample of each block is compared across blocks, so one very long run is
still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.functions.ranks import last_rank, lower_median, nearest_rank, order_statistics, order_statistics_of_counts
from obsgauge.functions.timebins import bin_of, plus_seconds, seconds_between
from obsgauge.sources.shared import written

# Fixed values of the verdicts.
GAP_FACTOR = 3
MIN_GAP_S = 120
FLAT_GROWTH_PERCENT = 15.0

BLOCK_S = 86400


def with_previous(samples: DataFrame, columns: Sequence[str], block_s: int = BLOCK_S) -> DataFrame:
    """Adds ``prev_<column>`` of the sample before, within a run.

    Samples of a run are told apart by their time.
    """
    df = samples.withColumn("_block", bin_of(F.col("ts"), block_s))
    within = Window.partitionBy("run", "_block").orderBy("ts")
    across = Window.partitionBy("run").orderBy("_block")
    last = F.max_by(F.struct(*columns), "ts")
    carried = (df.groupBy("run", "_block").agg(last.alias("_last"))
               .select(F.col("run").alias("_run"), F.col("_block").alias("_at"), F.lag("_last").over(across).alias("_carried")))
    same = F.col("run").eqNullSafe(F.col("_run")) & F.col("_block").eqNullSafe(F.col("_at"))
    df = df.withColumn("_here", F.lag(F.struct(*columns)).over(within)).join(carried, same)
    prev = F.coalesce("_here", "_carried")
    return df.select(*samples.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def steps_between(samples: DataFrame, block_s: int = BLOCK_S) -> DataFrame:
    """Per run and sample: seconds since the sample before (NULL at the first one), and whether the counter fell."""
    return (with_previous(samples, ["ts", "items"], block_s)
            .select("run", "ts", "prev_ts", seconds_between(F.col("prev_ts"), F.col("ts")).alias("step_s"),
                    F.coalesce(F.col("items") < F.col("prev_items"), F.lit(False)).alias("restarted")))


def _with_limit(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """Steps with ``_limit``, the length above which one is a gap: max(3 × lower median step, 120 s)."""
    usual = order_statistics_of_counts(lengths, ["run"], "step_s", "_c", {"_median": lower_median})
    limit = F.greatest(F.lit(float(MIN_GAP_S)), F.lit(GAP_FACTOR) * F.col("_median"))
    usual = usual.select(F.col("run").alias("_run"), limit.alias("_limit"))
    return steps.join(usual, F.col("run").eqNullSafe(F.col("_run")), "left").drop("_run")


def _step_lengths(steps: DataFrame) -> DataFrame:
    """How often each step length occurs in a run, and how often the counter fell over it; written once."""
    return written(steps.groupBy("run", "step_s").agg(F.count(F.lit(1)).alias("_c"), F.count_if("restarted").alias("_r")), "step-lengths")


def run_gaps(samples: DataFrame) -> DataFrame:
    """Holes in a run: steps longer than max(3 × lower median step, 120 s)."""
    steps = steps_between(samples)
    return (_with_limit(steps, _step_lengths(steps)).where(F.col("step_s") > F.col("_limit"))
            .select("run", F.col("prev_ts").alias("after"), F.col("step_s").alias("missing_s")))


def run_continuity(samples: DataFrame) -> DataFrame:
    """Samples, gaps, longest gap and counter restarts per run, all from one table of step lengths."""
    lengths = _step_lengths(steps_between(samples))
    gap = F.col("step_s") > F.col("_limit")
    zero = F.lit(0).cast("bigint")
    return (_with_limit(lengths, lengths).groupBy("run")
            .agg(F.sum("_c").alias("samples"), F.coalesce(F.sum(F.when(gap, F.col("_c"))), zero).alias("gaps"),
                 F.coalesce(F.max(F.when(gap, F.col("step_s"))), F.lit(0.0)).alias("longest_gap_s"), F.sum("_r").alias("restarts"))
            .withColumn("segmented", (F.col("gaps") > 0) | (F.col("restarts") > 0)))


def memory_verdict(samples: DataFrame, warmup_s: float = 7200) -> DataFrame:
    """Lower median memory of the first and last quarter of a run: two rows a run, with its warm-up and without.

    ``warmup_excluded`` tells them apart and ``samples`` how many each rests on; which one counts is the
    caller's choice.  A run without samples after the warm-up has one row.
    """
    start = samples.groupBy("run").agg(F.min("ts").alias("_t0"))
    late = F.col("ts") >= plus_seconds(F.col("_t0"), warmup_s)
    kept = samples.join(start, "run").select(
        "run", "rss", seconds_between(F.col("_t0"), F.col("ts")).alias("_at"),
        F.explode(F.when(late, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("warmup_excluded"))
    keys = ["run", "warmup_excluded"]

    def quarter(n):
        return F.greatest(F.floor(n / 4).cast("bigint"), F.lit(1).cast("bigint"))

    # Borders of the quarters are order statistics of time, so no run is ordered as a whole.
    borders = order_statistics(kept, keys, "_at", {
        "_q1": quarter, "_q4": lambda n: n - quarter(n) + 1}).select(*keys, F.col("n").alias("samples"), "_q1", "_q4")
    placed = kept.join(borders, keys)
    ends = placed.select(*keys, "samples", "rss", F.explode(F.array_compact(F.array(
        F.when(F.col("_at") <= F.col("_q1"), F.lit("first")),
        F.when(F.col("_at") >= F.col("_q4"), F.lit("last"))))).alias("_end"))
    medians = (order_statistics(ends, [*keys, "samples", "_end"], "rss", {"_m": lower_median})
               .groupBy(*keys, "samples").agg(F.max(F.when(F.col("_end") == "first", F.col("_m"))).alias("first_rss"),
                                              F.max(F.when(F.col("_end") == "last", F.col("_m"))).alias("last_rss")))
    growth = F.when(F.col("first_rss") > 0, (F.col("last_rss") - F.col("first_rss")) / F.col("first_rss") * 100
                    ).otherwise(F.lit(0.0))
    return (medians.withColumn("growth_percent", growth)
            .select("run", "samples", "warmup_excluded", "first_rss", "last_rss", "growth_percent",
                    (F.col("growth_percent") <= FLAT_GROWTH_PERCENT).alias("flat")))


def run_throughput(samples: DataFrame) -> DataFrame:
    """Window rotation seen (tracked pairs fall), last evictions, mean items per second per run."""
    falls = (with_previous(samples, ["pairs"]).groupBy("run")
             .agg(F.coalesce(F.max((F.col("pairs") < F.col("prev_pairs")) & (F.col("prev_pairs") > 0)), F.lit(False))
                  .alias("rotated")))
    ends = samples.groupBy("run").agg(
        F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.min_by("items", "ts").alias("_i0"),
        F.max_by("items", "ts").alias("_i1"), F.max_by("evictions", "ts").alias("evictions"))
    elapsed = seconds_between(F.col("_a"), F.col("_b"))
    return ends.join(falls, "run").select(
        "run", "rotated", "evictions", elapsed.alias("elapsed_s"),
        F.when(elapsed > 0, (F.col("_i1") - F.col("_i0")) / elapsed).alias("items_per_s"))


def aggregate_distribution(aggregates: DataFrame, keys: Sequence[str] = ("aggregate",),
                           measures: Sequence[str] | None = None) -> DataFrame:
    """n, median, P90, P99, maximum and the row behind the maximum, per aggregate and measure."""
    rows = aggregates.select("service", "aggregate", "dims", F.explode("fields").alias("measure", "value"))
    if measures is not None:
        rows = rows.where(F.col("measure").isin(*measures))
    keys = [*keys, "measure"]
    label = F.concat_ws("/", F.col("service"), F.col("dims")["metric"], F.col("dims")["attribute"])
    stats = order_statistics(rows, keys, "value", {
        "median": lower_median, "p90": nearest_rank(90.0), "p99": nearest_rank(99.0), "max": last_rank})
    # Ties go to the smallest label; max_by over (value, label) needs the label order turned round.
    top = (rows.groupBy(*keys).agg(F.max("value").alias("_max"))
           .join(rows.withColumn("_label", label), keys).where(F.col("value") == F.col("_max"))
           .groupBy(*keys).agg(F.min("_label").alias("top")))
    return stats.join(top, keys)


def exemplar_services(coverage: DataFrame) -> DataFrame:
    """Services with an exemplar, and services with histograms."""
    return coverage.agg(F.count_if(F.col("with_exemplars") > 0).alias("with_exemplars"),
                        F.count(F.lit(1)).alias("services"))


def report_ratio_summary(report_ratios: DataFrame) -> DataFrame:
    """Per rule over saved reports: hits in the last report, lower median and largest ratio."""
    stats = order_statistics(report_ratios, ["rule_id"], "ratio", {"median": lower_median, "max": last_rank})
    newest = report_ratios.agg(F.max("file")).scalar()
    last = (report_ratios.withColumn("_newest", newest).where(F.col("file") == F.col("_newest"))
            .groupBy("rule_id").agg(F.count(F.lit(1)).alias("last_services")))
    return (stats.join(last, "rule_id", "left")
            .select("rule_id", "n", F.coalesce("last_services", F.lit(0)).alias("last_services"), "median", "max"))
