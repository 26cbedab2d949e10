"""Intake that survives what it is given: refused payloads and late rows go to tables of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsgauge.functions.timebins import micros
from obsgauge.sources.otlp import FLATTEN, SCHEMAS
from obsgauge.streaming.batches import finished, read_batches, write_batch

REFUSED = "payload string, reason string, file string"
MARKS = "latest timestamp"
_BROKEN = "_broken"


def judged_payloads(texts: DataFrame, signal: str, value: str = "value") -> DataFrame:
    """``texts`` with ``m``, the parsed payload, and ``reason``: NULL, or why it is refused.

    *malformed*: no JSON object, or a field of the wrong type.  *no payload*: an object without the signal's list of
    resources that is not empty either.  Blank texts are no payloads and vanish.
    """
    outer = SCHEMAS[signal].partition(" ")[0]
    parsed = F.from_json(F.col(value).cast("string"), f"{SCHEMAS[signal]}, {_BROKEN} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    empty = F.col(value).cast("string").rlike(r"^\s*\{\s*\}\s*$")
    rows = texts.where(F.trim(F.regexp_replace(F.col(value).cast("string"), r"\s+", " ")) != "").withColumn("m", parsed)
    reason = (F.when(F.col("m").isNull() | F.col(f"m.{_BROKEN}").isNotNull(), "malformed")
              .when(F.col(f"m.{outer}").isNull() & ~empty, "no payload"))
    return rows.withColumn("reason", reason)


def start_otlp_intake(spark: SparkSession, signal: str, path: str, items: str, refused: str, checkpoint: str, whole_files: bool = False,
                      max_files: int | None = None, every: str | None = None) -> StreamingQuery:
    """A directory of payload texts (one a line, or one a file) to a table of items and a table of refused payloads.

    Both tables get a folder a batch.  A bad payload costs itself only: its text, the reason and the file go to
    ``refused`` (``read_refused``), the others of its file to ``items``.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    texts = reader.text(path, wholetext=whole_files).select("value", F.col("_metadata.file_path").alias("file"))

    def store(batch: DataFrame, number: int) -> None:
        rows = judged_payloads(batch, signal)
        good = FLATTEN[signal](rows.where(F.col("reason").isNull()).select("m.*").drop(_BROKEN))
        write_batch(good, items, number)
        write_batch(rows.where(F.col("reason").isNotNull()).select(F.col("value").alias("payload"), "reason", "file"), refused, number)

    writer = texts.writeStream.queryName(f"intake_{signal}").foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def items_schema(spark: SparkSession, signal: str):
    return FLATTEN[signal](spark.createDataFrame([], SCHEMAS[signal])).schema


def read_items(spark: SparkSession, signal: str, items: str) -> DataFrame:
    return read_batches(spark, items, items_schema(spark, signal))


def read_refused(spark: SparkSession, refused: str) -> DataFrame:
    return read_batches(spark, refused, REFUSED)



def start_with_late_table(rows: DataFrame, path: str, checkpoint: str, delay_s: int, ts: str = "ts", every: str | None = None) -> StreamingQuery:
    """Deal a stream into ``path``/on_time and ``path``/late.

    The watermark of a batch is the latest ``ts`` of all batches before it minus the delay, as for
    a stateful operator; it is stored with each batch, so a restart goes on where it stopped.  Late rows carry
    ``watermark`` and ``late_by_s``.  Rows without a time are on time: no window takes them.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in finished(spark, f"{path}/marks") if n < number]
        mark = read_batches(spark, f"{path}/marks", MARKS, before[-1:]).agg(F.max("latest")).first()[0]
        watermark = F.lit(mark).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay_s))
        late = F.coalesce(F.col(ts) < watermark, F.lit(False))
        by = ((micros(F.lit(mark).cast("timestamp")) - F.lit(delay_s * 1_000_000) - micros(F.col(ts))) / 1e6)
        write_batch(batch.where(~late), f"{path}/on_time", number)
        write_batch(batch.where(late).withColumns({"watermark": watermark, "late_by_s": by}), f"{path}/late", number)
        # The mark comes last: a batch without one is dealt again by the same mark as before.
        latest = batch.agg(F.greatest(F.max(ts), F.lit(mark).cast("timestamp")).alias("latest"))
        write_batch(latest, f"{path}/marks", number)

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_late(spark: SparkSession, path: str, schema_of: DataFrame) -> DataFrame:
    """Every late row since the first start, with the watermark it missed."""
    ddl = schema_of.withColumns({"watermark": F.lit(None).cast("timestamp"), "late_by_s": F.lit(None).cast("double")}).schema
    return read_batches(spark, f"{path}/late", ddl)


def late_counts(spark: SparkSession, path: str, schema_of: DataFrame) -> DataFrame:
    """Late rows per batch: count, greatest delay."""
    return read_late(spark, path, schema_of).groupBy("batch").agg(F.count("*").alias("late"), F.max("late_by_s").alias("most_late_by_s"))
