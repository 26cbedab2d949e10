"""Telemetry quality, spend and alert analytics as Spark DataFrame operators."""

from obsgauge.session import build_session

__all__ = ["build_session"]
