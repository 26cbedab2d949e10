"""Print the physical plan of registered queries: python tests/plan.py sf_dir name ..."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def main() -> None:
    from obsgauge import build_session
    from obsgauge.plans.registry import QUERIES

    folder, *names = sys.argv[1:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        df = QUERIES[name](spark, folder)
        df.collect()
        print("=====", name)
        df.explain("formatted")


if __name__ == "__main__":
    main()
