from obsgauge.functions import attributes, ranks, runs, timebins

__all__ = ["attributes", "ranks", "runs", "timebins"]
