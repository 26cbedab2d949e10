"""Streams into batch tables: dead letters, late rows, published gauges; nothing is lost or doubled by a restart."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsgauge.operators import aggregates as agg
from obsgauge.operators import scoring
from obsgauge.plans.catalogue import ITEM_RULES, rule
from obsgauge.plans.flows import Scoring
from obsgauge.streaming import (
    batches, export_gauges, late_counts, read_gauges, read_items, read_late, read_refused, start_otlp_intake, start_with_late_table,
)
from util import rows


def payload(*bodies):
    return json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]},
                                         "scopeLogs": [{"logRecords": [{"body": {"stringValue": b}} for b in bodies]}]}]})


BAD = {'{"resourceLogs": [': "malformed", "noise": "malformed", '{"resourceSpans": []}': "no payload", "[1, 2]": "malformed", '"text"': "malformed",
       '{"resourceLogs": "wrong type"}': "malformed"}


def test_bad_payloads_cost_themselves_only(spark, tmp_path):
    source, items, refused, state = (str(tmp_path / n) for n in ("in", "items", "refused", "state"))
    (tmp_path / "in").mkdir()

    def run():
        start_otlp_intake(spark, "log", source, items, refused, state, max_files=1).awaitTermination()

    lines = [payload("a"), "", "{}", *BAD, payload("bb", "ccc")]
    (tmp_path / "in" / "1.json").write_text("\n".join(lines))
    (tmp_path / "in" / "2.json").write_text(payload("dddd"))
    run()
    assert rows(read_items(spark, "log", items), "service", "body_len") == [("shop", n) for n in (1, 2, 3, 4)]
    assert rows(read_refused(spark, refused), "payload", "reason") == sorted(BAD.items(), key=repr)
    assert {r.file.rpartition("/")[2] for r in read_refused(spark, refused).collect()} == {"1.json"}
    (tmp_path / "in" / "3.json").write_text("more noise\n" + payload("eeeee"))
    run()
    run()  # nothing new
    assert rows(read_items(spark, "log", items), "body_len") == [(n,) for n in (1, 2, 3, 4, 5)]
    assert read_refused(spark, refused).count() == len(BAD) + 1


def test_a_batch_written_again_replaces_itself_and_half_a_batch_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3)
    batches.write_batch(df, path, 0)
    batches.write_batch(df, path, 0)
    batches.write_batch(df, path, 1)
    (tmp_path / "t" / "batch=1" / "_SUCCESS").unlink()
    assert batches.finished(spark, path) == [0]
    assert batches.read_batches(spark, path, df.schema).count() == 3
    assert batches.read_batches(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_one_file_payloads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(json.loads(payload("x", "yy")), indent=2))
    (tmp_path / "in" / "b.json").write_text("{\n broken")
    start_otlp_intake(spark, "log", *(str(tmp_path / n) for n in ("in", "items", "refused", "state")), whole_files=True).awaitTermination()
    assert rows(read_items(spark, "log", str(tmp_path / "items")), "body_len") == [(1,), (2,)]
    assert read_refused(spark, str(tmp_path / "refused")).count() == 1


def test_late_rows_are_kept_with_their_delay_over_restarts(spark, tmp_path):
    noon = datetime(2024, 1, 1, 12)
    frame = lambda *minutes: spark.createDataFrame([(k, m if m is None else noon + timedelta(minutes=m)) for k, m in enumerate(minutes)], "id long, ts timestamp")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for minutes in ((0, 60), (-5, 55, None, 30), (49, 50, 90), (10,)):
        frame(*minutes).coalesce(1).write.mode("append").parquet(source)
        start_with_late_table(spark.readStream.schema("id long, ts timestamp").parquet(source), out, state, 600).awaitTermination()
    late = read_late(spark, out, frame(0))
    assert rows(late, F.round((F.unix_timestamp("ts") - noon.timestamp()) / 60).cast("int"), "late_by_s") == sorted(
        [(-5, 55 * 60.0), (30, 20 * 60.0), (49, 60.0), (10, 70 * 60.0)], key=repr)
    assert sum(r.late for r in late_counts(spark, out, frame(0)).collect()) == 4
    assert batches.read_batches(spark, f"{out}/on_time", "id long, ts timestamp").count() == 6


@pytest.mark.parametrize("windowed", [True, False])
def test_readers_between_ticks_see_a_whole_version(tables, tmp_path, windowed):
    spark, points = tables.spark, tables.points()
    rules = [*ITEM_RULES, rule("EXT-MET-001")]
    out, source, state = (str(tmp_path / n) for n in ("out", "in", "state"))
    assert read_gauges(spark, out).count() == 0
    shown = ["gauge", "service", "impact", F.round("value", 9)]
    cut = points.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    seen = []
    for part in (points.where(F.col("ts") < cut), points.where(F.col("ts") >= cut)):
        part.write.mode("append").parquet(source)
        all_so_far = spark.read.schema(points.schema).parquet(source)
        coverage = agg.exemplar_coverage(all_so_far)
        if windowed:  # what a stream writes: whole days that have closed
            coverage = agg.exemplar_coverage(all_so_far.where(F.col("ts") < F.date_trunc("day", F.lit(cut)) if part is not None and not seen else F.lit(True)), window="1 day")
        stream = spark.readStream.schema(points.schema).parquet(source)
        export_gauges({"metric": stream}, rules, out, every=None, aggregates=lambda _s, c=coverage: {"exemplar_coverage": c}, checkpoint=state).awaitTermination()
        seen.append(rows(read_gauges(spark, out), *shown))
    assert batches.finished(spark, f"{out}/gauges") == [0, 1] and seen[0] != seen[1]
    if not windowed:
        s = Scoring(spark, {"metric": points}, rules)
        assert seen[1] == rows(scoring.score_gauges(s.scores, s.findings), *shown)
    else:  # every closed window was judged once: the carried counters equal a judgement of all windows
        from obsgauge.operators.rules import aggregate_rollup
        from obsgauge.streaming.running import JUDGED

        want = aggregate_rollup({"exemplar_coverage": agg.exemplar_coverage(points, window="1 day")}, rules)
        assert rows(batches.read_batches(spark, f"{out}/judged", JUDGED, [1]).drop("batch")) == rows(want)
