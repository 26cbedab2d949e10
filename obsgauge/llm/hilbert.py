"""Shards along a Hilbert curve over metadata, for files that prune in several dimensions.

Each dimension is quantised to ``2 ** BITS`` cells: names by their rank among
the distinct names, the size by its logarithm.  Cells become the index on the
Hilbert curve through the cube of cells, whose neighbours on the curve are neighbours in
space; rows in the order of the index (ties by hash, so a hot cell spreads) are
cut into runs of equal length.  A shard then holds a compact region, so its
files' smallest and largest name, language and size exclude most shards of a query.

The order is global but nothing is sorted in one place: rows are dealt by
ranges, each range is numbered apart, and the ranges' counts give the offsets.

Law ``rows``: the shards' numbers of rows differ by at most one.

Defined cases: a NULL text counts as the empty one (size 8, CRC of no bytes); NULL
names are a name of their own, first in the order; equal rows get slots of their own
next to each other; fewer rows than shards leave shards empty; an empty table
gives no rows.  Only id, text and the named dimensions are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.sources.shared import written

SHARDS = 24
BITS = 5


def hilbert_index(axes: list, bits: int):
    """Index on the Hilbert curve of arrays of cell numbers, one array a dimension (any number of them).

    Gray-code walk from the highest bit: undo the reflections and exchanges that the curve makes in
    the sub-cube of each higher bit, then read the bits across the dimensions.
    """
    x = [np.asarray(a, "int64").copy() for a in axes]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(len(x)):
            reflect = (x[k] & q) != 0
            swap = np.where(reflect, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(reflect, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap if k else 0
        q >>= 1
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(len(x)):
            index = (index << 1) | (((x[k] ^ flip) >> bit) & 1)
    return index


def _name_cells(rows: DataFrame, name: str) -> DataFrame:
    """(key, cell): distinct names, ranked, spread over the cells."""
    names = rows.select(F.col(name).alias("key")).distinct()
    rank, n = F.row_number().over(Window.orderBy("key")) - 1, F.count("*").over(Window.partitionBy())
    return written(names.select("key", F.floor(rank * (1 << BITS) / F.greatest(n, F.lit(1 << BITS))).cast("int").alias("cell")), "cells")


def size_cell(size: Column) -> Column:
    """One and a half cells for each doubling, from 8 bytes on."""
    return F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor(F.log2(size / 8.0) * 1.5))).cast("int")


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank``: 0-based place in the global order of the keys, and ``total``.

    The dealt rows are written once, so a range keeps its rows when an executor is lost.
    """
    dealt = written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = written(parts.select("part", F.coalesce(upto, F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total")), "offsets")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return dealt.join(parts, "part").withColumn("rank", F.col("start") + inside).drop("part", "start")


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("source", "lang"),
           n_shards: int = SHARDS) -> DataFrame:
    """(id, size, crc, curve, shard, slot): shard and gapless slot of every row along the curve."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                       *[F.col(n).cast("string").alias(f"n{k}") for k, n in enumerate(names)])
    for k in range(len(names)):
        cells = _name_cells(rows, f"n{k}").withColumnRenamed("cell", f"c{k}")
        rows = rows.join(cells, rows[f"n{k}"].eqNullSafe(cells.key)).drop("key", f"n{k}")

    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], BITS))

    curve = F.pandas_udf(index, "long")(*[F.col(f"c{k}") for k in range(len(names))], size_cell(F.col("size")))
    rows = rows.select("id", "size", "crc", curve.alias("curve"), F.xxhash64("id", "crc").alias("tie"))
    placed = ranked(rows, ["curve", "tie", "id", "crc", "size"])
    shard = F.expr(f"rank * {n_shards} div total")
    start = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - start).cast("long")).drop("rank", "total", "tie")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (NULL: the law is not ``key``), curve."""
    return shards(docs).select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                               "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
