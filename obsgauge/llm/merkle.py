"""Merkle manifest of a table: a root for each source, one root above them, and the proof of every row.

A leaf is the SHA-256 of a row's fields.  Leaves are ranked in their source; the
rank, written in base ``FAN``, says where a leaf hangs.  The nodes of ``FAN ** DIGITS``
consecutive ranks are one block.  In a block the digits are grouped away one after
another, last digit first: each grouping hashes a run of nodes and nests them as
the children of the new one.  All groupings of a block go by (source, block) and
need one shuffle.  When a block has one node left, a transform walks the nested
structs downwards, notes for every leaf the siblings left and right of its path, and
explode emits the leaves.  Nothing is joined to find a sibling.

The blocks' nodes are the leaves of the next round, as narrow rows (the nested column
stays in its written table); the path above a block comes back as one row a block and
meets it in a grouping by (source, block).  Rounds end when every source has one node;
the subroots are then climbed in the same way as the leaves of one tree.  So a round
divides rows by ``FAN ** DIGITS``, no group has more rows than that, and a source that holds a third
of the table is as many blocks as its size asks for.

Defined cases: a NULL field counts as ``-``, an empty text as ``0:``; NULL ids come first in
their source and the NULL source first among the sources; repeated ids are
ordered by their leaves, equal rows are leaves of their own; a source of one row has
its leaf as subroot, a table of one source its subroot as root; rows that are alone on
every level have an empty proof; an empty table gives no rows; other columns, whatever
their names, are not read; texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.sources.shared import written

FAN = 3
DIGITS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf_of(*fields: Column) -> Column:
    """Hash of a row: every field as ``-`` or as its length in bytes, a colon and the value."""
    plain = [f.cast("string") for f in fields]
    return digest_of(*[F.when(p.isNull(), "-").otherwise(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)) for p in plain])


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings (left, right) of each level."""
    return F.aggregate(path, leaf, lambda h, step: digest_of(step["left"], h, step["right"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the 0-based place in the row's ``tree`` by ``order``, and ``n``, the rows of the tree.

    Rows are dealt by ranges of (tree, order), so a large tree spreads; the offsets are one row a range and tree in it.
    """
    dealt = written(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "dealt")
    tree = Window.partitionBy("at_tree")
    counts = dealt.groupBy(F.col("tree").alias("at_tree"), F.col("part").alias("at_part")).agg(F.count("*").alias("own"))
    counts = counts.select("at_tree", "at_part", F.sum("own").over(tree).alias("n"),
                           (F.sum("own").over(tree.orderBy("at_part")) - F.col("own")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(
        written(counts, "offsets"), F.col("tree").eqNullSafe(F.col("at_tree")) & (F.col("part") == F.col("at_part")))
    return placed.withColumn("rank", F.col("start") + F.col("inside")).drop("at_tree", "at_part", "part", "start", "inside")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, n, block, hash, node) of nodes (tree, n, rank, hash, item) that stand ``height`` levels above the leaves."""
    digits = [f"d{k}" for k in range(DIGITS)]
    cut = {"block": F.expr(f"rank div {FAN ** DIGITS}"),
           **{d: F.expr(f"cast(rank div {FAN ** k} % {FAN} as int)") for k, d in enumerate(digits)}}
    rows = nodes.withColumns(cut).select("tree", "n", "block", *digits, "hash", F.struct("hash", "item").alias("node")).repartition("tree", "block")
    for k, digit in enumerate(digits):
        run = rows.groupBy("tree", "n", "block", *digits[k + 1:]).agg(
            F.array_sort(F.collect_list(F.struct(digit, F.col("hash"), F.col("node")))).alias("run"))
        kids = F.transform("run", lambda x: x["node"])
        joined = F.sha2(F.array_join(F.transform("run", lambda x: x["hash"]), ""), 256)
        # While its tree has other nodes on this level, even a lone node is hashed; afterwards nodes pass through.
        grown = F.when(F.col("n") > FAN ** (height + k), joined).otherwise(F.col("run")[0]["hash"])
        rows = (run.withColumn("hash", grown).withColumn("node", F.struct("hash", kids.alias("kids")))
                .select("tree", "n", "block", *digits[k + 1:], "hash", "node"))
    return rows


def _paths(node: Column, n: Column, height: int, left: int) -> Column:
    """Array of (item, path) of the items under a node that nests ``left`` levels."""
    if not left:
        return F.array(F.struct(node["item"].alias("item"), F.array().cast("array<struct<left: string, right: string>>").alias("path")))

    def hashes(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda x: x["hash"]), "")

    def child(kid: Column, at: Column) -> Column:
        kids = node["kids"]
        step = F.array(F.struct(hashes(F.slice(kids, 1, at)).alias("left"), hashes(F.slice(kids, at + 2, FAN)).alias("right")))
        grown = F.when(n > FAN ** (height + left - 1), step).otherwise(F.array().cast("array<struct<left: string, right: string>>"))
        return F.transform(_paths(kid, n, height, left - 1), lambda p: F.struct(p["item"].alias("item"), F.concat(p["path"], grown).alias("path")))

    return F.flatten(F.transform(node["kids"], child))


def climb(nodes: DataFrame, height: int, crown) -> DataFrame:
    """(tree, rank, item, path, top) of every node (tree, n, rank, hash, item).

    ``crown(tops)`` takes (tree, hash), one row a tree, and returns (tree, path, top): what
    stands above the trees.  ``path`` leads from the node through all levels.
    """
    blocks = written(_blocks(nodes, height), "blocks")
    if (blocks.agg(F.max("block")).first()[0] or 0) > 0:
        bare = blocks.select("tree", "n", F.col("block").alias("rank"), "hash", F.lit(None).cast("boolean").alias("item"))
        above = climb(bare, height + DIGITS, crown).select("tree", F.col("rank").alias("block"), "path", "top")
    else:
        above = crown(blocks.select("tree", "hash")).select("tree", F.lit(0).cast("long").alias("block"), "path", "top")
    both = blocks.select("tree", "block", "n", "node").unionByName(above, allowMissingColumns=True)
    met = both.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "top")])
    below = met.select("tree", "block", "path", "top", F.posexplode(_paths(F.col("node"), F.col("n"), height, DIGITS)).alias("at", "leaf"))
    return below.select("tree", (F.col("block") * FAN ** DIGITS + F.col("at")).alias("rank"), F.col("leaf.item").alias("item"),
                        F.concat("leaf.path", "path").alias("path"), "top")


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(tree, rank, item, path, subroot, root) of every leaf (tree, hash, item, and the columns of ``order``).

    ``path`` holds the siblings (left, right; hex digests in a row) from the leaf's level up to the root.
    """

    def alone(tops):
        return tops.select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("hash").alias("top"))

    def over_trees(tops):
        named = tops.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "hash", F.struct(F.col("tree").alias("name"), "hash").alias("item"))
        climbed = climb(ranked(named, ["name"]).drop("name"), 0, alone)
        return climbed.select(F.col("item.name").alias("tree"), "path", F.struct(F.col("item.hash").alias("subroot"), F.col("top").alias("root")).alias("top"))

    rows = climb(ranked(leaves, order).select("tree", "n", "rank", "hash", "item"), 0, over_trees)
    return rows.select("tree", "rank", "item", "path", "top.subroot", "top.root")


def proofs(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields: tuple[str, ...] = FIELDS,
           also: dict[str, Column] | None = None) -> DataFrame:
    """(id, tree, leaf, path, subroot, root and the columns ``also``) of every row of ``docs``."""
    more = also or {}
    item = F.struct(F.col(id_col).alias("id"), leaf_of(*[F.col(f) for f in fields]).alias("leaf"), *[c.alias(name) for name, c in more.items()])
    leaves = docs.select(F.col(tree_col).cast("string").alias("tree"), item.alias("item"))
    # Equal rows are dealt apart by the row number; which of them is which makes no difference.
    leaves = written(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    leaves = leaves.select("tree", F.col("item.leaf").alias("hash"), "item", F.col("item.id").alias("id"), "tie")
    rows = manifest(leaves, ["id", "hash", "tie"])
    return rows.select(F.col("item.id").alias("id"), "tree", F.col("item.leaf").alias("leaf"), "path", "subroot", "root",
                       *[F.col(f"item.{name}").alias(name) for name in more])


def digest(docs: DataFrame) -> DataFrame:
    """Leaves, roots and proofs, and what becomes of each proof when line breaks of every other id's text go."""
    hit = F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    bent = F.when(hit, leaf_of(*[F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]))
    rows = proofs(docs, also={"bent": bent})
    rows = rows.withColumn("folded_root", folded(F.coalesce("bent", "leaf"), F.col("path")))
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
