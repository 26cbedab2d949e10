"""Near copies by the likeness of their word shingles: Jaccard of the sets of five-word shingles >= 0.8.

SimHash fingerprints of the sets give the first candidates: those at most two bits apart, joined on their Golay keys.  At 0.8 about
ten bits differ, so what the fingerprints cannot find comes from sorted signature orders among the components that they left; ``lsh_forest`` says how
and with which chance a pair is missed.  All links are confirmed on the hashed shingle sets.

Texts with equal sets of shingles are one node.  A key that many different texts share is divided by further
minima until at most ``lsh_forest.CROWD`` nodes share it, so a node has a bounded number of candidates
however crowded its keys are, and a large group of near copies costs rows as its nodes.

Defined cases: words are cut at ASCII white space and compared in lower case
(ASCII); a text of fewer than five words is one shingle; NULL and wordless texts
are alike; the smallest id (then text hash) stays, NULL ids only if there is no other; of equal rows one stays;
input columns may have any name; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.llm import golay, lsh_forest
from obsgauge.sources.shared import written

SHINGLE = 5


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates among (node, fp), each fingerprint's smallest node with its other nodes and with those of fingerprints two bits away or less."""
    first = F.min("node").over(Window.partitionBy("fp"))
    equal = nodes.select(first.alias("a"), F.col("node").alias("b")).where("a <> b")
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head")), "fingerprints")
    pairs = golay.links(heads).where("a < b")
    pairs = (pairs.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("one")), "a")
             .join(heads.select(F.col("fp").alias("b"), F.col("head").alias("other")), "b"))
    return equal.unionByName(pairs.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id (then text hash) of each group of near copies, with all its columns; of equal rows one."""
    rows = lsh_forest.row_keys(docs, id_col, text_col)
    own = lsh_forest.signed(rows, SHINGLE)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("best")
    groups = own.groupBy("name").agg(best, F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("fp").alias("fp"))  # no name: the empty set
    nodes = written(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    worded = nodes.where("name is not null").select("node", "n", "paths", "best.k1", "best.k2")
    first = written(by_fingerprint(nodes.where("name is not null").select("node", "fp")), "fingerprint-pairs")
    placed = nodes.select("node", "best").join(lsh_forest.linked(worded, rows, SHINGLE, first), "node", "left")
    stay = placed.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("best").alias("best")).select("best.k1", "best.k2")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.lit(1), id_col, text_col).alias("k1"),
                        F.xxhash64(F.lit(2), text_col, id_col).alias("k2"))
    return whole.join(written(stay, "representatives"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")
