"""Starting streams: checkpoint folders, tables, the periodic gauge export, late rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from obsgauge.operators import scoring
from obsgauge.operators.rules import aggregate_rollup, rule_results
from obsgauge.plans.catalogue import Rule, catalogue_frame
from obsgauge.session import checkpoint_folder
from obsgauge.streaming.batches import drop_batches, finished, read_batches, write_batch
from obsgauge.streaming.windows import stream_rule_rollup


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    """The folder a caller names, else one for this stream in the cluster's shared folder."""
    if given is not None:
        return given
    root = checkpoint_folder(spark)
    if root is None:
        raise ValueError("spark.checkpoint.dir is not set and no checkpoint folder was given")
    return f"{root.rstrip('/')}/{name}"


def start_table(df: DataFrame, path: str, name: str, checkpoint: str | None = None,
                every: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet folder; without ``every`` it takes what is there and stops."""
    writer = (df.writeStream.queryName(name).outputMode("append").format("parquet").option("path", path)
              .option("checkpointLocation", _checkpoint(df.sparkSession, name, checkpoint)))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_available(df: DataFrame, path: str, name: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all available input and read its table back."""
    query = start_table(df, path, name, checkpoint)
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the last batches of a running query dropped behind the watermark; ``start_with_late_table`` keeps them all."""
    return sum(op.get("numRowsDroppedByWatermark", 0)
               for p in query.recentProgress for op in p.get("stateOperators", []))


GAUGES = "gauge string, service string, impact string, value double"
JUDGED = "service string, rule_id string, observed bigint, violations bigint, eval_errors bigint"
MARKS = "aggregate string, upto timestamp"
#: Published versions that stay, for readers that have begun.
KEPT_VERSIONS = 3


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    """The gauges of the newest version that is whole; no rows before the first tick."""
    return read_batches(spark, f"{path}/gauges", GAUGES, finished(spark, f"{path}/gauges")[-1:]).drop("batch")


def _judged_so_far(tables: Mapping[str, DataFrame], rules: Sequence[Rule], path: str, number: int) -> DataFrame:
    """Counters of the aggregate rules over all closed windows: those of the version before and the windows closed since.

    Stored with their marks (the latest window judged of each aggregate) as version ``number``.
    """
    spark = next(iter(tables.values())).sparkSession
    last = [n for n in finished(spark, f"{path}/marks") if n < number][-1:]
    marks = {r.aggregate: r.upto for r in read_batches(spark, f"{path}/marks", MARKS, last).collect()}  # one row an aggregate
    fresh = {name: df.where(F.col("window_start") > F.lit(marks[name])) if marks.get(name) else df for name, df in tables.items()}
    parts = read_batches(spark, f"{path}/judged", JUDGED, last).drop("batch").unionByName(aggregate_rollup(fresh, rules))
    counters = [F.sum(c).cast("bigint").alias(c) for c in ("observed", "violations", "eval_errors")]
    write_batch(parts.groupBy("service", "rule_id").agg(*counters), f"{path}/judged", number)
    newest = [df.agg(F.greatest(F.max("window_start"), F.lit(marks.get(name)).cast("timestamp")).alias("upto"))
              .select(F.lit(name).alias("aggregate"), "upto") for name, df in fresh.items()]
    write_batch(reduce(DataFrame.unionByName, newest), f"{path}/marks", number)
    return read_batches(spark, f"{path}/judged", JUDGED, [number]).drop("batch")


def export_gauges(signals: Mapping[str, DataFrame], rules: Sequence[Rule], path: str, name: str = "gauges",
                  aggregates: Callable[[SparkSession], Mapping[str, DataFrame]] | None = None,
                  checkpoint: str | None = None, every: str | None = "30 seconds") -> StreamingQuery:
    """Every tick: roll-up → rules → scores → gauges, published as a version of their own.

    A version is a numbered folder that counts once it is whole, so ``read_gauges`` sees the last version or the new
    one; a tick that is run again writes its version again.  ``aggregates`` reads the tables that the windowed streams
    write (closed windows only): those with a ``window_start`` are judged window by window, each once, and their counters carried
    from version to version; others are judged whole on each tick.
    """
    item_rules = [r for r in rules if r.aggregate is None]
    spark = next(iter(signals.values())).sparkSession

    def publish(rollup: DataFrame, number: int) -> None:
        session = rollup.sparkSession
        catalogue = catalogue_frame(session, rules)
        parts = rollup
        tables = dict(aggregates(session)) if aggregates is not None else {}
        windowed = {k: df for k, df in tables.items() if "window_start" in df.columns}
        whole = {k: df for k, df in tables.items() if k not in windowed}
        if windowed:
            parts = parts.unionByName(_judged_so_far(windowed, rules, path, number))
        if whole:
            parts = parts.unionByName(aggregate_rollup(whole, rules))
        results = rule_results(parts, catalogue)
        gauges = scoring.score_gauges(scoring.service_scores(results), scoring.findings(results, catalogue))
        write_batch(gauges.select([F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(GAUGES)]), f"{path}/gauges", number)
        for table in ("gauges", "judged", "marks"):
            drop_batches(session, f"{path}/{table}", KEPT_VERSIONS)

    writer = (stream_rule_rollup(signals, item_rules).writeStream.queryName(name).outputMode("complete")
              .foreachBatch(publish).option("checkpointLocation", _checkpoint(spark, name, checkpoint)))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()
