"""Runs of consecutive grid positions (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block of the two-level pass.
BLOCK = 4096


def consecutive_runs(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Maximal runs of consecutive integers per key: ``first_pos``, ``last_pos``.

    Two levels, so that no key has to fit in one task.  Runs are found inside
    blocks of ``BLOCK`` positions first; only runs that touch a block border
    (at most two per block) go through the per-key pass that stitches them.
    Positions must be distinct per key.
    """
    block = F.floor(F.col(position) / BLOCK).cast("bigint")
    inner = Window.partitionBy(*keys, "_block").orderBy(position)
    local = (df.select(*keys, F.col(position).alias(position), block.alias("_block"))
             .withColumn("_grp", F.col(position) - F.row_number().over(inner))
             .groupBy(*keys, "_block", "_grp")
             .agg(F.min(position).alias("first_pos"), F.max(position).alias("last_pos"))
             .withColumn("_edge", (F.col("first_pos") == F.col("_block") * BLOCK)
                         | (F.col("last_pos") == F.col("_block") * BLOCK + BLOCK - 1)))
    # Border runs share the NULL scope of their key; inner runs stay with their block.
    scope = F.when(~F.col("_edge"), F.col("_block"))
    outer = Window.partitionBy(*keys, "_scope").orderBy("first_pos")
    joined = F.coalesce(F.col("first_pos") == F.lag("last_pos").over(outer) + 1, F.lit(False))
    return (local.withColumn("_scope", scope)
            .withColumn("_new", F.when(joined, 0).otherwise(1))
            .withColumn("_run", F.sum("_new").over(outer.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*keys, "_scope", "_run")
            .agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
            .drop("_scope", "_run"))
