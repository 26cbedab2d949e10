"""Structured Streaming twins of the batch operators.

Event time decides the window; rows later than the watermark are dropped and
counted in the query progress (``late_rows``), or kept in a table of their own (``start_with_late_table``).
"""

from obsgauge.streaming.alerts import alert_events, firings_from_events
from obsgauge.streaming.intake import late_counts, read_items, read_late, read_refused, start_otlp_intake, start_with_late_table
from obsgauge.streaming.running import export_gauges, late_rows, read_gauges, run_available, start_table
from obsgauge.streaming.tracestate import read_trace_health, start_trace_health, stream_trace_verdicts
from obsgauge.streaming.windows import stream_cardinality, stream_cardinality_sketches, stream_rule_rollup

__all__ = ["alert_events", "export_gauges", "firings_from_events", "late_counts", "late_rows", "read_gauges", "read_items", "read_late",
           "read_refused", "read_trace_health", "run_available", "start_otlp_intake", "start_table", "start_trace_health",
           "start_with_late_table", "stream_cardinality", "stream_cardinality_sketches", "stream_rule_rollup", "stream_trace_verdicts"]
