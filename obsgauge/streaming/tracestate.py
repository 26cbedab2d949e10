"""Trace health as a stream: each trace is held until its window has closed, then judged once."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from obsgauge.session import use_rocksdb
from obsgauge.streaming.batches import read_batches, write_batch

COUNTS = "service string, window_start timestamp, traces bigint, orphans bigint, rootless bigint"
#: Groups that the traces are dealt to; a checkpoint keeps the number it began with.
GROUPS = 4096
#: Spans or verdicts in one stored or returned text.
PIECE = 10_000
#: A new stream's watermark stands at 1970, and pandas has no times after 2262.
FIRST_US, LAST_US = 1, 9_214_646_400_000_000
# Ship the processor itself, so that workers (one starts beside the driver) need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TraceJudge(StatefulProcessor):
    """State of a group of traces: their spans as numbered packed texts, one timer.

    A call to the state store costs far more than a span, so calls are made for groups: a batch adds what is new in a group
    without reading the rest; the texts are read when the timer fires, at the latest when the first trace of the group is due.
    Traces that are not due yet stay.  Spans come and verdicts go as JSON texts, as each cell of a row costs a conversion.
    """

    def __init__(self, patience_s: int):
        self.patience_us = patience_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        # A key for each text: an append to a list state reads the list, to count it.
        self.pieces = handle.getMapState("pieces", "number bigint", "spans string")
        self.timer = handle.getValueState("timer", "due bigint, pieces bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old, count = self.timer.get() or (None, 0)
        due = old
        for part in rows:
            self.pieces.updateValue((count,), ("[" + ",".join(part["span"].unique()) + "]",))
            own = int(part["due"].min())
            due, count = own if due is None else min(due, own), count + 1
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
        self.timer.update((due, count))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        traces: dict[str | None, list] = {}
        services: dict[str | None, str | None] = {}
        for number in range(self.timer.get()[1]):
            for trace, span, parent, service, *first, last in json.loads(self.pieces.getValue((number,))[0]):
                first, last, link = [int(t) for t in first], int(last), (span, parent, services.setdefault(service, service))
                if (known := traces.get(trace)) is None:
                    traces[trace] = [first, last, {link}]
                else:
                    known[0], known[1] = min(first, known[0]), max(last, known[1])
                    known[2].add(link)
        now, due, kept, verdicts = timerValues.getCurrentWatermarkInMs(), None, [], []
        for trace, (first, last, links) in traces.items():
            _, start, close = first
            own = -(-max(close, last + self.patience_us) // 1000)
            if own > now:
                kept += [(trace, *link, *first, last) for link in links]
                due = own if due is None else min(due, own)
            else:
                verdicts += _verdicts(trace, start, links)
        self.pieces.clear()
        self.timer.clear()
        if kept:
            starts = range(0, len(kept), PIECE)
            for number, i in enumerate(starts):
                self.pieces.updateValue((number,), (json.dumps(kept[i:i + PIECE]),))
            self.handle.registerTimer(due)
            self.timer.update((due, len(starts)))
        for i in range(0, len(verdicts), PIECE):
            yield pd.DataFrame({"verdicts": [json.dumps(verdicts[i:i + PIECE])]})

    def close(self) -> None:
        pass


def _verdicts(trace: str | None, start: int, links: set) -> list[tuple]:
    """A finished trace, judged for each service in it."""
    known = {span for span, _, _ in links}
    dangling: dict[str | None, bool] = {}
    for _, parent, service in links:
        dangling[service] = dangling.get(service, False) or (parent is not None and parent not in known)
    rootless = all(parent is not None for _, parent, _ in links)
    broken = any(dangling.values())
    return [(trace, service, start, own, rootless and (own or not broken)) for service, own in dangling.items()]


def stream_trace_verdicts(spans: DataFrame, window: str = "1 hour", delay: str = "10 minutes", patience_s: int = 600) -> DataFrame:
    """(trace_id, service, window_start, dangling, blamed) of every finished trace, in the window of its earliest span (append mode).

    A trace is finished when the watermark has passed the end of that window and ``patience_s`` after its last span.
    A span that comes later still begins a trace of its own.  Needs the RocksDB state store, which is set where the session has another.
    """
    use_rocksdb(spans.sparkSession)
    rows = spans.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(F.col("trace_id").cast("string")), F.lit(GROUPS)).alias("part"), "trace_id", "span_id", "parent_span_id", "service", "ts",
        F.unix_micros("ts").alias("at"), F.window("ts", window).alias("w"))
    rows = rows.withColumns({"start": F.unix_micros("w.start"), "close": F.unix_micros("w.end")})
    span = F.to_json(F.array(*[F.col(c).cast("string") for c in ("trace_id", "span_id", "parent_span_id", "service", "at", "start", "close", "at")]))
    # A trace is not due before its earliest due span would be on its own.
    due = F.expr(f"greatest(close, at + {patience_s * 1_000_000}) div 1000")
    # Spark drops late spans by this column, and nothing else reads it; the metadata says that it bears the watermark.
    first, last = (F.timestamp_micros(F.lit(t)) for t in (FIRST_US, LAST_US))
    ts = F.least(F.greatest("ts", first), last).alias("ts", metadata=rows.schema["ts"].metadata)
    found = rows.select("part", ts, span.alias("span"), due.alias("due")).groupBy("part").transformWithStateInPandas(
        TraceJudge(patience_s), "verdicts string", "append", "eventTime")
    v = F.explode(F.from_json("verdicts", "array<array<string>>", {"mode": "FAILFAST"})).alias("v")
    return found.select(v).select(
        F.col("v")[0].alias("trace_id"), F.col("v")[1].alias("service"), F.timestamp_micros(F.col("v")[2].cast("bigint")).alias("window_start"),
        F.col("v")[3].cast("boolean").alias("dangling"), F.col("v")[4].cast("boolean").alias("blamed"))


def start_trace_health(spans: DataFrame, path: str, checkpoint: str, every: str | None = None, **how) -> StreamingQuery:
    """Counts per service and window of the traces that finish in each batch, a folder a batch."""

    def store(verdicts: DataFrame, number: int) -> None:
        write_batch(verdicts.groupBy("service", "window_start").agg(
            F.count("*").alias("traces"), F.count_if("dangling").alias("orphans"), F.count_if("blamed").alias("rootless")), path, number)

    writer = stream_trace_verdicts(spans, **how).writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def read_trace_health(spark: SparkSession, path: str) -> DataFrame:
    """What ``trace_health(window=...)`` gives, from the counts of all batches."""
    traces = F.sum("traces")
    return read_batches(spark, path, COUNTS).groupBy("service", "window_start").agg(
        traces.alias("traces"), (F.sum("orphans") / traces).alias("orphan_ratio"), (F.sum("rootless") / traces).alias("missing_root_ratio"))
