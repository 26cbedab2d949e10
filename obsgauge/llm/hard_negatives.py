"""Hard negatives for contrastive training: for each positive of an anchor, the best-scored rows of other labels in a window under it.

Vectors become whole numbers (each component times ``SCALE``, rounded down), so scores are exact inner
products and ties are real ties.  Anchors are taken in blocks of ``BLOCK``; a block's vectors are the only thing
sent to every task, and their number does not grow with the table.  A task meets a block batch by batch as
one matrix product and keeps, for each anchor, only what may still be in the answer:

1. positives: the best ``POSITIVES`` rows of the anchor's label that the task has seen,
2. once the positives of the block are known: the best ``NEGATIVES`` rows of other labels
   that the task has seen inside the window of each positive.

Whatever is best over all tasks is among the best of its own task, so nothing of the answer is lost, and a task hands on at most
``POSITIVES * (NEGATIVES + 1)`` pairs an anchor however many rows it reads.

Pairs are packed into keys (anchor, descending score, id), dealt by the anchor and sorted in the shuffle
(``repartitionAndSortWithinPartitions``).  One pass over a partition's sorted iterator answers all its
anchors: a positive opens its window, each row of another label goes to the open windows that
hold its score, and a window closes when it is full.  An anchor's pairs are never held together; the state is its open windows.

Defined cases: rows with a NULL id, label or vector or a NULL or non-finite component take no part; components past
the length of the shorter vector count as zero; an empty vector scores 0 with everything; equal scores are ordered by the id, then by the label; repeated rows are rows
of their own, but no row counts as "other" for an anchor of the same id, and of anchors with one id the one
with the smallest label, then vector, stays; scores beyond 64 bits are set to the nearest 64-bit number; an anchor without
positives or negatives gives no rows; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of its positive's score.
LOW, HIGH = 30, 90
#: Anchors met at once: with 1,000 components their vectors are 16 MB.
BLOCK = 2048
#: Rows of a task that one matrix product takes: scores of 16 MB.
ROWS = 1024
OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
LARGEST = (1 << 63) - 1
EXACT = 1 << 53


def taking_part(rows: DataFrame, id_col: str, vector_col: str, label_col: str, label_of) -> DataFrame:
    """(id, label, v): the rows that can be scored; ``v`` holds whole numbers as doubles."""
    kept = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("raw"))
    fine = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("raw").isNotNull() & fine)
    # Rounding down keeps the double: beyond 2 ** 53 every double is whole already.
    whole = F.transform("raw", lambda x: F.when(F.abs(x) < 1 << 44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return kept.select("id", label_of(F.col("id"), F.col("label")).cast("long").alias("label"), whole.alias("v"))


class Scorer:
    """Exact inner products of a block of anchors with batches of rows."""

    def __init__(self, anchors):
        self.ids = np.array([a[0] for a in anchors], "int64")
        self.labels = np.array([a[1] for a in anchors], "int64")
        self.width = max((len(a[2]) for a in anchors), default=0)
        self.matrix = self.padded([a[2] for a in anchors])
        self.most = float(np.abs(self.matrix).max(initial=0.0))

    def padded(self, vectors):
        out = np.zeros((len(vectors), self.width))
        if vectors and all(len(v) == self.width for v in vectors):
            out[:] = vectors
        else:
            for k, v in enumerate(vectors):
                out[k, :min(len(v), self.width)] = v[:self.width]
        return out

    def scores(self, vectors):
        """(anchors, rows) as 64-bit numbers; doubles are exact while every partial sum stays under 2 ** 53."""
        m = self.padded(vectors)
        if self.width * self.most * float(np.abs(m).max(initial=0.0)) < EXACT:
            return np.rint(self.matrix @ m.T).astype("int64")
        ours, theirs = ([[int(x) for x in row] for row in a] for a in (self.matrix, m))
        return np.array([[max(-LARGEST, min(LARGEST, sum(map(int.__mul__, a, b)))) for b in theirs] for a in ours], "int64").reshape(len(ours), len(theirs))

    def batches(self, rows):
        """(ids, labels, scores) of the rows, ``ROWS`` at a time, each sorted by (id, label)."""
        rows = iter(rows)
        while part := list(itertools.islice(rows, ROWS)):
            part.sort(key=lambda r: (r[0], r[1]))
            yield (np.array([r[0] for r in part], "int64"), np.array([r[1] for r in part], "int64"), self.scores([r[2] for r in part]))


def _arrow_rows(batches):
    for batch in batches:
        ids, labels, vectors = batch.columns
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = vectors.offsets.to_numpy()
        ends = ends - ends[0]
        for k, (i, label) in enumerate(zip(ids.to_pylist(), labels.to_pylist())):
            yield i, label, flat[ends[k]:ends[k + 1]]


def _merged(kept, fresh, most):
    """The first ``most`` of two lists of keys (-score, id, label)."""
    return sorted(kept + fresh)[:most]


def task_positives(scorer: Scorer, rows):
    """For each anchor of the block the best rows of its label among ``rows``: (anchor number, -score, id, label)."""
    best = [[] for _ in scorer.ids]
    for ids, labels, scores in scorer.batches(rows):
        for label in np.unique(labels):
            at, own = np.nonzero(labels == label)[0], np.nonzero(scorer.labels == label)[0]
            falling = -scores[np.ix_(own, at)]
            order = np.argsort(falling, axis=1, kind="stable")
            for anchor, values, row in zip(own, falling, order):
                row = row[ids[at[row]] != scorer.ids[anchor]][:POSITIVES]
                best[anchor] = _merged(best[anchor], [(v, i, int(label)) for v, i in zip(values[row].tolist(), ids[at[row]].tolist())], POSITIVES)
    return [(anchor, *key) for anchor, keys in enumerate(best) for key in keys]


def window(positive_score: int) -> tuple[int, int]:
    """Lowest and highest score of a positive's negatives."""
    return -(-LOW * positive_score // 100), HIGH * positive_score // 100


def task_negatives(scorer: Scorer, positives, rows):
    """The best rows of other labels in the window of each positive among ``rows``: (anchor number, -score, id, label)."""
    spans = [sorted({window(-p[0]) for p in of}) for of in positives]
    best = [{s: [] for s in of if s[0] <= s[1]} for of in spans]
    for ids, labels, scores in scorer.batches(rows):
        order = np.argsort(-scores, axis=1, kind="stable")
        for anchor, windows in enumerate(best):
            if not windows:
                continue
            row = order[anchor]
            row = row[(labels[row] != scorer.labels[anchor]) & (ids[row] != scorer.ids[anchor])]
            falling = -scores[anchor, row]
            for (low, high), kept in windows.items():
                first, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                part = slice(first, min(end, first + NEGATIVES))
                fresh = list(zip(falling[part].tolist(), ids[row[part]].tolist(), labels[row[part]].tolist()))
                if fresh:
                    windows[low, high] = _merged(kept, fresh, NEGATIVES)
    return [(anchor, *key) for anchor, windows in enumerate(best) for key in sorted({k for kept in windows.values() for k in kept})]


def mined(pairs):
    """Rows of ``OUT`` from sorted ((anchor id, -score, id, label), anchor label): one pass, holding the open windows only."""
    anchor = None
    for (anchor_id, falling, other, label), own in pairs:
        score = -falling
        if anchor_id != anchor:
            anchor, seen, windows, level, tied = anchor_id, 0, [], None, []
        if score != level:
            level, tied = score, []
        if label == own:
            if seen < POSITIVES:
                seen += 1
                low, high = window(score)
                if low <= high:
                    opened = [other, score, low, high, 0]
                    windows.append(opened)
                    # Only under a positive with score 0 may negatives of the same score stand before it.
                    for negative in tied if low <= score <= high else ():
                        opened[4] += 1
                        yield anchor, other, opened[4], negative, score, score
            continue
        if len(tied) < NEGATIVES:
            tied.append(other)
        for opened in windows:
            positive, positive_score, low, high, n = opened
            if n < NEGATIVES and low <= score <= high:
                opened[4] = n + 1
                yield anchor, positive, n + 1, other, positive_score, score
        windows = [w for w in windows if w[4] < NEGATIVES and w[2] <= score]


def _first_of_each(pairs):
    """The first ``POSITIVES`` pairs of each anchor of a sorted iterator."""
    anchor, n = None, 0
    for key, own in pairs:
        anchor, n = (anchor, n + 1) if key[0] == anchor else (key[0], 1)
        if n <= POSITIVES:
            yield key, own


def _in_windows(sent):
    return lambda scorer, rows: task_negatives(scorer, sent.value, rows)


def _pairs(rows: DataFrame, scored, block):
    """Pairs of every task as ((anchor id, -score, id, label), anchor label)."""

    def run(batches):
        found = scored(block.value, _arrow_rows(batches))
        ids, labels = block.value.ids.tolist(), block.value.labels.tolist()
        for at in range(0, len(found), 10_000):
            columns = list(zip(*((ids[a], *key, labels[a]) for a, *key in found[at:at + 10_000])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "s", "i", "l", "own"])

    return rows.mapInArrow(run, "a bigint, s bigint, i bigint, l bigint, own bigint").rdd.map(lambda r: (tuple(r)[:4], r[4]))


def _place(key) -> int:
    """Anchors' ids may share factors with the number of partitions; their product with an odd number's upper bits do not."""
    return (key[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32


def _sorted_by_key(pairs, partitions: int):
    return pairs.repartitionAndSortWithinPartitions(partitions, _place)


def hard_negatives(rows: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   label_of=lambda i, label: label, block_size: int = BLOCK) -> DataFrame:
    """Rows of ``OUT``: for every anchor and positive the first negatives of the window.

    ``is_anchor(id)`` and ``label_of(id, label)`` are column functions.  Each block of anchors is met with all rows.
    """
    spark = rows.sparkSession
    taking = taking_part(rows, id_col, vector_col, label_col, label_of)
    anchors = taking.where(is_anchor(F.col("id"))).groupBy("id").agg(F.min(F.struct("label", "v")).alias("own"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answer = spark.createDataFrame([], OUT)
    after = None
    while True:
        rest = anchors if after is None else anchors.where(F.col("id") > after)
        taken = [(r.id, r.own.label, r.own.v) for r in rest.orderBy("id").limit(block_size).collect()]
        if not taken:
            return answer
        after = taken[-1][0]
        block = spark.sparkContext.broadcast(Scorer(taken))
        positives = _sorted_by_key(_pairs(taking, task_positives, block), partitions).mapPartitions(_first_of_each)
        positives = positives.persist(StorageLevel.DISK_ONLY)  # computed again from the table where an executor is lost
        number = {a[0]: k for k, a in enumerate(taken)}
        known = [[] for _ in taken]
        for (anchor, *key), _ in positives.collect():  # at most POSITIVES an anchor of the block
            known[number[anchor]].append(tuple(key))
        sent = spark.sparkContext.broadcast(known)
        negatives = _pairs(taking, _in_windows(sent), block)
        answer = answer.unionByName(spark.createDataFrame(_sorted_by_key(negatives.union(positives), partitions).mapPartitions(mined), OUT))
        if len(taken) < block_size:
            return answer


def digest(rows: DataFrame) -> DataFrame:
    """The task's anchors and labels: ids divisible by 100; the label of ids divisible by 7 is moved on by one."""
    return hard_negatives(rows, lambda i: i % 100 == 0, label_of=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
