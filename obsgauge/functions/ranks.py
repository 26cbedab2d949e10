"""Exact order statistics per key, without gathering or sorting a whole key.

Ranks follow two fixed index formulas (``lower_median`` and ``nearest_rank``)
that neither ``percentile`` nor ``percentile_approx`` reproduces.  The work is
split so that it also holds for a key with billions of rows:

1. count equal values (map-side combine) and write the counts to the shared
   folder, so the source is read once however many ranks are wanted;
2. cut the value axis into bins by a monotone function of the value; their
   number is bounded by the function (some 30,000 up to 1e13), not by the data;
3. cumulative counts over the bins of a key tell which bin holds a wanted rank;
4. cut that bin's own range from its smallest to its largest value into ``CUTS`` parts, twice
   over, so values that are large against their spread are told apart as well;
5. only the values of the last part are ordered.

Steps 2 to 5 are one plan over the written counts: one table for ``order_statistics``, two for ``robust_stats``.
Keys are compared as a whole, NULLs in them included: rows with a NULL key are a group like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.sources.shared import written

#: Bins per unit of log1p(|value|).
RESOLUTION = 1000.0
#: Parts of a bin's own range.
CUTS = 4096

Rank = Callable[[Column], Column]


def lower_median(n: Column) -> Column:
    """1-based rank of the lower median."""
    return F.floor((n - 1) / 2).cast("bigint") + 1


def nearest_rank(p: float) -> Rank:
    """1-based rank of the p-th percentile: p/100 * n rounded half up, clamped to 1..n."""

    def rank(n: Column) -> Column:
        raw = F.floor(F.lit(p) / F.lit(100.0) * n + F.lit(0.5)).cast("bigint")
        return F.least(F.greatest(raw, F.lit(1)), n)

    return rank


def last_rank(n: Column) -> Column:
    return n


def _value_counts(df: DataFrame, key: Column, value: Column, weight: Column) -> DataFrame:
    counts = (df.select(key.alias("_k"), value.cast("double").alias("_v"), weight.alias("_w")).where("_v is not null")
              .groupBy("_k", "_v").agg(F.sum("_w").alias("_c")))
    return written(counts, "value-counts")


def _key(keys: list[str]) -> Column:
    return F.struct(*(keys or [F.lit(1).alias("_all")]))


def _holding(parts: DataFrame, order: str) -> DataFrame:
    """The parts (with ``_before``, ``_c``) that hold their ``rank``, cumulated in the given order per (_k, stat)."""
    upto = Window.partitionBy("_k", "stat").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("_to", F.col("_before") + F.sum("_c").over(upto))
    return (parts.where((F.col("rank") > F.col("_to") - F.col("_c")) & (F.col("rank") <= F.col("_to")))
            .withColumn("_before", F.col("_to") - F.col("_c")).drop("_to"))


def _pick(counts: DataFrame, wanted: Mapping[str, Rank]) -> DataFrame:
    """(_k, n, one column per wanted rank) from (_k, _v, _c)."""
    log = F.signum("_v") * F.log1p(F.abs("_v")) * F.lit(RESOLUTION)
    counts = counts.withColumn("_bin", F.floor(log).cast("bigint"))
    bins = counts.groupBy("_k", "_bin").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    bins = bins.withColumn("n", F.sum("_c").over(Window.partitionBy("_k")))
    ranks = F.array(*[F.struct(F.lit(name).alias("stat"), rank(F.col("n")).alias("rank")) for name, rank in wanted.items()])
    parts = bins.select("*", F.lit(0).cast("bigint").alias("_before"), F.inline(ranks))
    at = _holding(parts, "_bin").drop("_c")

    def inside(at: DataFrame) -> DataFrame:
        return counts.join(at, ["_k", "_bin"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))

    for _ in range(2):
        wide = F.col("_hi") > F.col("_lo")
        part = F.when(wide, F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * CUTS), F.lit(CUTS - 1))).otherwise(F.lit(0))
        parts = (inside(at).groupBy("_k", "stat", "_bin", "rank", "n", "_before", part.alias("_part"))
                 .agg(F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        at = _holding(parts, "_part").drop("_c", "_part")
    found = _holding(inside(at), "_v")
    return found.groupBy("_k").agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("stat") == name, F.col("_v"))).alias(name) for name in wanted])


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: Mapping[str, Rank]) -> DataFrame:
    """One row per key: ``n`` and one column per entry of ``wanted``.

    ``wanted`` maps a column name to a function from group size to 1-based
    rank.  NULL values are left out; a key without values has no row.
    """
    return _named(_pick(_value_counts(df, _key(keys), F.col(value), F.lit(1)), wanted), keys, wanted)


def order_statistics_of_counts(counts: DataFrame, keys: list[str], value: str, count: str, wanted: Mapping[str, Rank]) -> DataFrame:
    """``order_statistics`` from a stored table of distinct values per key and how often each occurs.

    The table is read several times; no job runs before the result is used.
    """
    plain = counts.select(_key(keys).alias("_k"), F.col(value).cast("double").alias("_v"), F.col(count).alias("_c"))
    return _named(_pick(plain.where("_v is not null"), wanted), keys, wanted)


def _named(found: DataFrame, keys: list[str], wanted: Mapping[str, Rank]) -> DataFrame:
    return found.select(*[F.col("_k")[k].alias(k) for k in keys], "n", *wanted)


def robust_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, lower median, MAD, P90, P99 and maximum per key."""
    counts = _value_counts(df, _key(keys), F.col(value), F.lit(1))
    first = ["n", "median", "p90", "p99", "max"]
    base = _pick(counts, {"median": lower_median, "p90": nearest_rank(90.0), "p99": nearest_rank(99.0), "max": last_rank})
    # The first statistics travel as part of the key of the deviations.
    deviations = counts.join(base, "_k").select(F.struct("_k", *first).alias("_k"), F.abs(F.col("_v") - F.col("median")).alias("_v"), "_c")
    mad = _pick(_value_counts(deviations, F.col("_k"), F.col("_v"), F.col("_c")), {"mad": lower_median})
    return mad.select(*[F.col("_k._k")[k].alias(k) for k in keys], "_k.n", "_k.median", "mad", "_k.p90", "_k.p99", "_k.max")
