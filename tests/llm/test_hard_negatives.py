import math
import random

import pytest
from pyspark.sql import functions as F

from obsgauge.llm import hard_negatives as hn

DDL = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=100):
    """The answer by definition, from every pair."""
    fine = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    chosen = {}
    for row in sorted((r for r in fine if r[0] % every == 0), key=lambda r: (r[0], r[1], r[2])):
        chosen.setdefault(row[0], row)
    out = []
    for anchor, label, vector in chosen.values():
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, other, v in fine if i != anchor)
        for falling, positive, _ in [s for s in scored if s[2] == label][:5]:
            hits = [(i, -f) for f, i, other in scored if other != label and 30 * -falling <= 100 * -f <= 90 * -falling]
            out += [(anchor, positive, rank, i, -falling, f) for rank, (i, f) in enumerate(hits[:10], 1)]
    return sorted(out)


def answer(frame, block=hn.BLOCK):
    got = hn.hard_negatives(frame, lambda i: i % 100 == 0, label_of=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label), block_size=block)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("block", [3, 2048])
def test_all_pairs_by_definition(spark, block):
    draw = random.Random(block)
    rows = [(k * 5, [draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(4)], draw.randint(0, 3)) for k in range(260)]
    assert answer(spark.createDataFrame(rows, DDL).repartition(5), block) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (100, [1.0, 0.0], 1), (100, [0.5, 0.5], 2), (1, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2),
            (3, None, 1), (4, [1.0], None), (None, [1.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 2), (8, [None, 1.0], 2), (9, [], 1), (10, [], 2),
            (11, [0.5], 3), (12, [0.4, 0.4, 9.0], 3), (13, [0.0, 0.0], 2), (7, [0.6, 0.6], 9), (200, [], 4), (14, [0.0], 4)]
    frame = spark.createDataFrame(rows, DDL).withColumns({"id": F.lit("x"), "v": F.lit(1), "own": F.lit(None).cast("string")})
    got = answer(frame.repartition(3))
    assert got == plain(rows) and len(got) > 20
    assert any(r[4] == 0 for r in got)  # a positive with score 0 and its ties
    assert answer(frame.limit(0)) == []


def test_scores_beyond_exact_doubles_and_64_bits(spark):
    rows = [(0, [3e12, 1.0], 1), (1, [3e3, 1.0], 1), (2, [2999.5, 1.0], 2), (3, [1e3, 0.5], 2), (4, [1e30, 0.0], 2), (5, [1e30, 0.0], 1)]
    got = answer(spark.createDataFrame(rows, DDL))
    assert [r for r in got if r[1] == 1] == [r for r in plain(rows) if r[1] == 1]
    assert {r[4] for r in got if r[1] == 5} <= {hn.LARGEST}


def test_the_iterator_holds_open_windows_only():
    def pairs():
        for score in range(10_000, 0, -1):
            yield (7, -score, 10_000 - score, 1 if score in (10_000, 9_999, 5_000) else 2), 1

    rows = list(hn.mined(pairs()))
    assert [r[5] for r in rows if r[1] == 0] == list(range(9_000, 8_990, -1))
    assert len(rows) == 30


def test_tasks_hand_on_a_bounded_number_of_pairs():
    draw = random.Random(1)
    rows = [(k, k % 3, [draw.random() * 100 // 1 for _ in range(3)]) for k in range(4000)]
    scorer = hn.Scorer(rows[:10])
    positives = hn.task_positives(scorer, iter(rows))
    assert len(positives) == 10 * hn.POSITIVES
    known = [[p[1:] for p in positives if p[0] == a] for a in range(10)]
    assert len(hn.task_negatives(scorer, known, iter(rows))) <= 10 * hn.POSITIVES * hn.NEGATIVES
