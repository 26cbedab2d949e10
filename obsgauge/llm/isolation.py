"""Quality rules by an isolation forest on rule statistics.

Base statistics of a text come from its words, lines and symbols; ratios of
them are the features.  A feature counts from what is usual, the ``USUAL`` quantile of the
good labelled rows, so ordinary variation takes no splits.  Each tree of an isolation forest splits ``SUBSAMPLE`` rows, as the method has it,
drawn of their own from all labelled rows, at random features and values; odd documents are isolated after few splits, so the mean path
length is their anomaly.  The threshold is the one that errs least on all
labelled rows of the learning folds, where rejecting a good document counts as
``GOOD_COUNTS`` times keeping a bad one.

Texts are measured once; what is learned and judged are the written numbers, a row a document.  Quantiles and the threshold
are exact over every labelled row: counts of equal values and running sums by parts of the value axis, never a whole column in one task.

A document is kept if no base rule fails and its anomaly is under the threshold.

Defined cases: NULL and empty texts have no words and fail the base rule; without
labelled rows of both kinds only the base rules decide; texts are read whole;
repeated rows and NULL ids are judged row by row; an empty table gives no
rows.  Only id and text are read.  The forest has at most ``TREES * SUBSAMPLE * 2`` nodes and goes with the task.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from obsgauge.functions.ranks import nearest_rank, order_statistics
from obsgauge.llm.common import fold, map_rows
from obsgauge.sources.shared import written

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
TREES = 128
SUBSAMPLE = 512
DEPTH = 9
PARTS = 1024  # of the range of anomalies
GOOD_COUNTS = 4.0
USUAL = 0.999
SEED = 11
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbol_ratio", "repeat_ratio", "dup_line_ratio", "upper_ratio", "exclamations", "same_as_before", "variety", "lone_symbols")


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five base statistics and the features of a text."""
    text = text or ""
    words = _WORDS.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(_SYMBOLS.findall(text))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = {w for w, k in Counter(windows).items() if k > 1}
            upto = 0  # words before this one are counted
            for at, window in enumerate(windows):
                if window in often:
                    repeated += at + 3 - max(at, upto)
                    upto = at + 3
    some = max(1, n)
    lone = sum(len(w) == 1 and not w.isalnum() for w in set(words)) and sum(len(w) == 1 and not w.isalnum() for w in words)
    features = (symbols / max(1, chars), repeated / some, dup_lines / max(1, len(lines)),
                sum(map(str.isupper, text)) / max(1, chars), text.count("!") / some,
                sum(map(str.__eq__, words, words[1:])) / some, min(1.0, 2 * len(set(words)) / some ** 0.9) if n else 0.0, lone / some)
    return (n, chars, symbols, dup_lines, repeated), features


def base_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def expected_depth(n: int) -> float:
    """Mean path length of an unsuccessful search among n keys: what a leaf of n rows still hides."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: feature (-1: leaf), split value, left child (right is the next), path length."""

    def __init__(self, rows, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = SEED):
        draw = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        self.trees = [self._grow(rows[draw.choice(len(rows), size, replace=False)], depth, draw) for _ in range(trees)]
        self.usual = max(expected_depth(size), 1.0)

    @classmethod
    def of(cls, trees, size: int) -> Forest:
        """Trees grown elsewhere, of ``size`` rows each."""
        out = cls.__new__(cls)
        out.trees, out.usual = [tuple(map(np.array, t)) for t in trees], max(expected_depth(size), 1.0)
        return out

    @staticmethod
    def _grow(rows, depth: int, draw):
        feature, value, left, path = [0], [0.0], [0], [0.0]
        todo = [(0, rows, 0)]
        while todo:
            node, part, level = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.nonzero(high > low)[0]
            if level >= depth or len(part) < 2 or not len(usable):
                feature[node], path[node] = -1, level + expected_depth(len(part))
                continue
            k = int(draw.choice(usable))
            cut = draw.uniform(low[k], high[k])
            child = len(feature)
            feature[node], value[node], left[node] = k, cut, child
            for extra in (feature, value, left, path):
                extra.extend([0, 0])
            below = part[:, k] < cut
            todo += [(child, part[below], level + 1), (child + 1, part[~below], level + 1)]
        return np.array(feature), np.array(value), np.array(left), np.array(path)

    def anomaly(self, rows):
        """2 ** -(mean path / usual path), for the rows of an array."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(rows), "int64")
            for _ in range(DEPTH + 1):
                k = feature[at]
                inner = k >= 0
                if not inner.any():
                    break
                go = left[at] + (rows[every, np.maximum(k, 0)] >= value[at])
                at = np.where(inner, go, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.usual)


def best_threshold(anomaly, good) -> float:
    """The cut with the least cost among the labelled rows: kept are those under it."""
    order = np.argsort(anomaly, kind="stable")
    a, g = anomaly[order], good[order]
    kept_bad = np.concatenate([[0], np.cumsum(~g)])
    lost_good = g.sum() - np.concatenate([[0], np.cumsum(g)])
    cost = kept_bad + GOOD_COUNTS * lost_good
    edge = np.concatenate([[True], a[1:] > a[:-1], [True]])  # equal values stay together
    best = int(np.nonzero(edge & (cost == cost[edge].min()))[0][-1])
    if best >= len(a):
        return float("inf")
    return float(a[best]) if best == 0 else float((a[best - 1] + a[best]) / 2)


class Model:
    def __init__(self, forest: Forest | None, usual, threshold: float):
        self.forest, self.usual, self.threshold = forest, usual, threshold

    def anomaly(self, features):
        return self.forest.anomaly(np.maximum(features - self.usual, 0)) if self.forest else np.zeros(len(features))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base statistics, x) of every document; x are its features."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def row(key, text):
            base, features = measure(text)
            return key, *base, list(map(float, features))

        return row

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, " + ", ".join(f"{s} bigint" for s in STATISTICS) + ", x array<double>", start)


def fit(numbers: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """Forest and threshold from all labelled rows of the learning folds; the driver gets the trees, eight quantiles and one cut."""
    marks = (labels.select(F.col("doc_id").alias(id_col), F.col("quality").cast("int").alias("label"))
             .where((fold(F.col("doc_id")) != 0) & F.col("label").isin(0, 1)).groupBy(id_col).agg(F.max("label").alias("label")))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    taught = written(numbers.join(marks, id_col).select("x", (F.col("label") == 1).alias("good"), (~failed).alias("passed"),
                                                        F.xxhash64(id_col, "x").alias("key")), "rule-rows")
    fine, bad = F.col("good") & F.col("passed"), ~F.col("good") & F.col("passed")
    seen = taught.agg(F.count("*").alias("rows"), F.count_if(fine).alias("fine"), F.count_if(bad).alias("bad")).first()
    if not seen.fine or not seen.bad:
        return Model(None, None, float("inf"))
    values = taught.where(fine).select(F.posexplode("x").alias("feature", "value"))
    found = order_statistics(values, ["feature"], "value", {"usual": nearest_rank(100 * USUAL)}).collect()
    usual = np.array([r.usual for r in sorted(found, key=lambda r: r.feature)])
    forest = grown(taught, seen.rows, usual)  # with the rows that fail a base rule: they show how far the ratios go
    return Model(forest, usual, cut(anomalies(taught.where("passed"), Model(forest, usual, 0.0))))


def grown(taught: DataFrame, rows: int, usual) -> Forest:
    """A forest of (x, key), a tree a group: of the rows whose hash for the tree is small, those with the ``SUBSAMPLE`` smallest."""
    size = min(SUBSAMPLE, rows)
    some = min(1.0, (SUBSAMPLE + 8 * SUBSAMPLE ** 0.5) / rows)  # eight standard deviations more than are taken
    space = 1 << 52

    def place(tree):
        return F.pmod(F.xxhash64(F.lit(SEED), tree, F.col("key")), F.lit(space))

    drawn = taught.select("x", "key", F.explode(F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: place(t) < F.lit(int(some * space)))).alias("tree"))
    order = Window.partitionBy("tree").orderBy(place(F.col("tree")), "key")
    drawn = drawn.withColumn("at", F.row_number().over(order)).where(F.col("at") <= size).select("tree", "x")

    def grow(key, part):
        import pandas as pd

        tree = Forest._grow(np.maximum(np.stack(part["x"].to_numpy()) - usual, 0), DEPTH, np.random.default_rng([SEED, int(key[0])]))
        return pd.DataFrame([[int(key[0]), *(a.tolist() for a in tree)]], columns=["tree", "feature", "value", "left", "path"])

    trees = drawn.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, value array<double>, left array<int>, path array<double>").orderBy("tree").collect()
    return Forest.of([(t.feature, t["value"], t.left, t.path) for t in trees], size)


def anomalies(taught: DataFrame, model: Model) -> DataFrame:
    """(anomaly, good) of (x, good)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array(part.column(0).to_pylist()).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([pa.array(model.anomaly(x), pa.float64()), part.column(1)], names=["anomaly", "good"])

    return taught.select("x", "good").mapInArrow(run, "anomaly double, good boolean")


def cut(rows: DataFrame) -> float:
    """``best_threshold`` of (anomaly, good), of any number of rows."""
    counts = written(rows.groupBy("anomaly", F.floor(F.col("anomaly") * PARTS).alias("part")).agg(
        F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")), "anomaly-counts")
    parts = counts.groupBy("part").agg(F.sum("g").alias("pg"), F.sum("b").alias("pb"))  # at most ``PARTS`` + 1 rows
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("pg", "pb")])
    inside = Window.partitionBy("part").orderBy("anomaly").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"p{c}")
    good, bad = (counts.agg(F.sum("g"), F.sum("b")).first())
    # Kept are the rows before this value.
    cost = before("b") + F.lit(GOOD_COUNTS) * (F.lit(good) - before("g"))
    best = counts.join(parts, "part").select("anomaly", cost.alias("cost")).agg(F.min(F.struct("cost", -F.col("anomaly")))).first()[0]
    if bad <= best[0]:
        return float("inf")
    here = -best[1]
    last = counts.where(F.col("anomaly") < here).agg(F.max("anomaly")).first()[0]
    return here if last is None else (last + here) / 2


def judged(numbers: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, base statistics, base_failed, anomaly, kept) of what ``measured`` gives."""
    kind = numbers.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{s} bigint" for s in STATISTICS) + ", base_failed boolean, anomaly double, kept boolean"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base = np.array([c.to_pylist() for c in part.columns[1:-1]], "int64")
                features = np.array(part.columns[-1].to_pylist()).reshape(-1, len(FEATURES))
                anomaly = model.anomaly(features)
                failed = base_failed(base[0], base[4])
                values = [*part.columns[:-1], pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly < model.threshold))]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return numbers.select(id_col, *STATISTICS, "x").mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly, kept."""
    numbers = written(measured(docs), "rule-numbers")
    return judged(numbers, fit(numbers, labels))
