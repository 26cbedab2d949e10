"""Counts a metrics, log or object-store backend would answer, computed from tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.functions.attributes import present
from obsgauge.functions.timebins import plus_seconds
from obsgauge.operators.rules import _union


def items_by_signal(signals: Mapping[str, DataFrame]) -> DataFrame:
    """Items received per signal; each table is counted from its own metadata-light scan."""
    return _union([df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("signal"), "items")
                   for name, df in signals.items()])


def active_series_by_service(samples: DataFrame, label: str = "service_name", rsd: float | None = None) -> DataFrame:
    """Distinct series per value of a label; series without the label are left out."""
    df = samples.select(F.col("labels")[label].alias("service"), "series_key").where(F.col("service").isNotNull())
    count = F.approx_count_distinct("series_key", rsd) if rsd else F.countDistinct("series_key")
    return df.groupBy("service").agg(count.alias("active_series"))


def label_cardinality(samples: DataFrame, metric: str, label: str) -> DataFrame:
    """Distinct values of one label on one metric: always one row, 0 when absent."""
    return (samples.where(F.col("metric") == metric)
            .agg(F.countDistinct(F.col("labels")[label]).alias("series"))
            .select(F.lit(metric).alias("metric"), F.lit(label).alias("attribute"), "series"))


def label_cardinalities(samples: DataFrame) -> DataFrame:
    """Distinct values of every (metric, label) in one pass."""
    return (samples.select("metric", F.explode("labels").alias("attribute", "value"))
            .groupBy("metric", "attribute").agg(F.countDistinct("value").alias("series")))


def log_bytes_by_service(logs: DataFrame, end, window_s: int, service: str = "service", size: str = "body_len") -> DataFrame:
    """Bytes per service in the window (end - window, end]; records without a service are dropped."""
    end_col = F.lit(end).cast("timestamp")
    inside = (F.col("ts") > plus_seconds(end_col, -window_s)) & (F.col("ts") <= end_col)
    return (logs.where(inside & present(F.col(service)))
            .groupBy(F.col(service).alias("service")).agg(F.sum(F.col(size).cast("bigint")).alias("bytes")))


def storage_by_class(objects: DataFrame) -> DataFrame:
    """Stored bytes per class; an object without a class is STANDARD."""
    cls = F.when(present(F.col("storage_class")), F.col("storage_class")).otherwise(F.lit("STANDARD"))
    return objects.groupBy(cls.alias("storage_class")).agg(F.sum(F.col("bytes").cast("bigint")).alias("bytes"))
