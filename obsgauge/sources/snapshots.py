"""Stored snapshots: score reports, cost reports, saved aggregates and run samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsgauge import schemas


def _append(df: DataFrame, path: str, taken_at) -> None:
    (df.withColumn("taken_at", F.lit(taken_at).cast("timestamp"))
     .withColumn("snapshot_date", F.lit(taken_at).cast("date"))
     .write.mode("append").partitionBy("snapshot_date").parquet(path))


def write_score_snapshot(path: str, scores: DataFrame, results: DataFrame, found: DataFrame,
                         fleet: DataFrame, taken_at) -> None:
    """Append one scoring to four tables below ``path``, partitioned by day."""
    for name, df in {"service_scores": scores, "rule_results": results, "findings": found,
                     "snapshots": fleet}.items():
        _append(df, f"{path}/{name}", taken_at)


def write_gauges(path: str, gauges: DataFrame) -> None:
    """Replace the current gauges, so services that went away disappear."""
    gauges.write.mode("overwrite").parquet(path)


def write_cost_snapshot(path: str, report: DataFrame, taken_at) -> None:
    _append(report.drop("taken_at"), path, taken_at)


def last_snapshot_before(history: DataFrame, before, at: str = "taken_at") -> DataFrame:
    """Rows of the latest snapshot strictly before an instant; empty if there is none.

    Where history is partitioned by ``snapshot_date``, later days are pruned in both reads and the
    second one, which meets the one aggregated row in a broadcast join, reads a single day.
    """
    instant = F.lit(before).cast("timestamp")
    earlier = history.where(F.col(at) < instant)
    on = [at]
    if "snapshot_date" in history.columns:
        earlier = earlier.where(F.col("snapshot_date") <= F.to_date(instant))
        on.append("snapshot_date")
    latest = earlier.agg(F.max(F.struct(*on)).alias("_m")).select("_m.*")
    return earlier.join(F.broadcast(latest), on, "left_semi")


def read_last_snapshot(spark: SparkSession, path: str, before, at: str = "taken_at") -> DataFrame | None:
    """Rows of the latest snapshot strictly before an instant in a stored history; NULL if there is none.

    Which days there are is read from the names of their folders; the newest day not after the instant is looked at first,
    so every scan is of one day and earlier ones are only met if that day has nothing before the instant.
    """
    instant = F.lit(before).cast("timestamp")
    limit = spark.range(1).select(F.to_date(instant).cast("string")).first()[0]
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/snapshot_date=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    days = {s.getPath().getName().partition("=")[2] for s in found or ()}
    for day in sorted((d for d in days if d <= limit), reverse=True):
        rows = spark.read.parquet(path).where((F.col("snapshot_date") == F.lit(day).cast("date")) & (F.col(at) < instant))
        latest = rows.agg(F.max(at)).first()[0]
        if latest is not None:
            return rows.where(F.col(at) == F.lit(latest))
    return None


def rule_ratio_history(stored_findings: DataFrame) -> DataFrame:
    """Every stored violation ratio per rule."""
    return stored_findings.select("rule_id", "ratio")


def read_aggregate_snapshots(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Union of saved aggregate files (arrays of rows) as (service, aggregate, dims, fields).

    Each row's fields are told apart by type: numbers are measures, texts are
    dimensions.
    """
    raw = spark.read.schema(schemas.AGGREGATE_ROW).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    fields = F.parse_json("Fields").cast("map<string,variant>")
    text = lambda v: F.schema_of_variant(v) == "STRING"  # noqa: E731  by JSON type: "404" is a dimension
    texts = F.transform_values(F.map_filter(fields, lambda _k, v: text(v)), lambda _k, v: v.cast("string"))
    numbers = F.transform_values(F.map_filter(fields, lambda _k, v: F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")),
                                 lambda _k, v: v.cast("double"))
    return raw.select(F.col("Service").alias("service"), F.col("Aggregate").alias("aggregate"),
                      texts.alias("dims"), numbers.alias("fields"))


def _reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return (spark.read.schema(schemas.SCORE_REPORT + ", _corrupt string")
            .option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .json(paths).withColumn("file", F.input_file_name()))


def unreadable_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, reason) of the saved reports that ``read_report_ratios`` cannot use."""
    raw = _reports(spark, paths)
    return raw.where(F.col("_corrupt").isNotNull() | F.col("snapshot").isNull()).select(
        "file", F.when(F.col("_corrupt").isNotNull(), "malformed").otherwise("no snapshot").alias("reason"))


def read_report_ratios(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rule_id, service, ratio) of every finding in saved reports; ``unreadable_reports`` names the others."""
    raw = _reports(spark, paths)
    return (raw.where(F.col("_corrupt").isNull() & F.col("snapshot").isNotNull())
            .select("file", F.explode("snapshot.services").alias("s"))
            .select("file", F.col("s.service").alias("service"), F.explode("s.findings").alias("f"))
            .select("file", "service", F.col("f.rule_id").alias("rule_id"), F.col("f.stats.ratio").alias("ratio")))


def read_soak_metrics(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Run samples from CSV by header name; numbers that cannot be read become 0.

    The run is the one given, else the file's name.  A time that cannot be read stops the job: it has no place in a run.

    A file without any sample is an error: an empty run must not pass as a
    quiet one.
    """
    raw = spark.read.option("header", True).csv(path)

    def number(name: str):
        if name not in raw.columns:
            raise ValueError(f"{path}: no column {name}")
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))

    name = F.lit(run) if run is not None else F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    out = raw.select(name.alias("run"), F.col("ts").cast("timestamp").alias("ts"), number("rss_bytes").alias("rss"),
                     number("pairs_tracked").alias("pairs"), number("evictions_total").alias("evictions"),
                     (number("items_traces") + number("items_metrics") + number("items_logs")).alias("items"))
    if out.isEmpty():
        raise ValueError(f"{path}: no samples")
    return out
