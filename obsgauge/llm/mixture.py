"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. A source's target is its weight's share of all words, at most ``cap`` times
   its own size; what is cut off is shared again by weight.  Sorted by
   cap / weight the capped sources come first, so one running sum over the
   sources (one row each) gives the common factor.
2. The mix is ``shards * blocks_per_shard`` blocks.  Each source gets an exact
   number of them (largest remainders) and cuts its target into that many equal runs of words.
3. The tree halves the shards again and again.  At each node the left half's
   blocks are drawn without replacement: block after block goes left with the
   chance (places left / blocks left).  Counts are exact on every level; a node
   is one row, so a level is one task-parallel projection and no shuffle.
4. A source's documents stand in the order of a seeded hash, repeated pass
   after pass up to the target.  Positions are two-level prefix sums (bucket
   totals, then inside a bucket), so no source is ordered in one task.  Blocks
   are permuted by hash, each shard takes its run of them, and rows are ordered
   by hash inside the shard.
5. What a document gives is what the shards' blocks take of it: its words in each pass are
   met with the blocks they lie in, a draw for each block, with the shard that the tree gave the block.

The words taken of a source add up to its target, rounded to a word: the last
document is taken up to the word that fills the target.

Defined cases: NULL text has no words and is never taken; a NULL source is a
source of its own, sorted last; repeated rows are rows of their own (which of
two equal rows comes first is of no consequence); a source without words takes
nothing, and no words at all gives targets of 0; an empty table gives no rows.
Only the id, source and text columns are read.  Nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.llm.common import n_words
from obsgauge.sources.shared import written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SHARDS = 16
BLOCKS_PER_SHARD = 64
PIECES = 64
SEED = 17


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, carry: bool) -> DataFrame:
    """A row a document: words and place in its source's order; ``carry``: with the whole row.

    ``src`` sorts as the sources do: a mark before each name, a later one for NULL.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~")).alias("src"),
        n_words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(SEED), text_col).alias("th"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    return rows.withColumn("u", _unit(F.lit(SEED), F.col("id"), F.col("th")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(src, source_size, docs, target): one row a source, of the frame with (src, size)."""
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy("src")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.get(listed, (F.row_number().over(by_name) - 1) % len(weights)))
    everything = Window.partitionBy()
    by_room = Window.orderBy("ratio", "src")
    per = per.withColumn("ratio", cap * F.col("source_size") / F.col("w"))
    # Were all sources before this one capped, the others' factor would be this; it holds at the first that needs no cap.
    per = (per.withColumn("all", F.sum("source_size").over(everything))
           .withColumn("capped", F.coalesce(F.sum(cap * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("open", F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("factor", (F.col("all") - F.col("capped")) / F.col("open")))
    # From there on it only falls.
    factor = F.max(F.when(F.col("factor") <= F.col("ratio"), F.col("factor"))).over(everything)
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.coalesce(factor, F.lit(0.0)) * F.col("w"))
    return per.select("src", "source_size", "docs", target.alias("target"))


def quotas(goals: DataFrame, blocks: int) -> DataFrame:
    """(src, blocks): exact block numbers by largest remainder; they add up to ``blocks`` if anything is taken."""
    everything = Window.partitionBy()
    share = F.when(F.sum("target").over(everything) > 0, F.col("target") * blocks / F.sum("target").over(everything)).otherwise(0.0)
    g = goals.withColumn("share", share).withColumn("base", F.floor("share").cast("long"))
    order = Window.orderBy((F.col("base") - F.col("share")).asc(), "src")
    g = (g.withColumn("missing", F.round(F.sum("share").over(everything)).cast("long") - F.sum("base").over(everything))
         .withColumn("got", F.col("base") + F.when(F.row_number().over(order) <= F.col("missing"), 1).otherwise(0)))
    # A source with a target has a block to itself even if its share is under half a block.
    return g.select("src", F.when(F.col("target") > 0, F.greatest("got", F.lit(1))).otherwise(0).alias("blocks"))


def splitting_tree(quota: DataFrame, shards: int) -> DataFrame:
    """(src, shard, n): how many blocks of each source each output shard gets.

    A node holds the sources' block numbers as one array, bounded by the number
    of sources.  ``draw`` folds over its blocks in source order with the state
    (blocks left, places left, taken per source): sampling without replacement,
    whose counts are multivariate hypergeometric.
    """
    sources = F.array_sort(F.collect_list(F.struct("src", F.col("blocks").alias("n"))))
    level = quota.where("blocks > 0").groupBy().agg(sources.alias("of")).select(
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.lit(1).cast("long").alias("node"), "of")
    width = shards
    while width > 1:
        width = (width + 1) // 2
        level = _halved(level)
    return level.select(F.col("lo").alias("shard"), F.explode("of").alias("s")).select("shard", "s.src", "s.n").where("n > 0")


def _halved(level: DataFrame) -> DataFrame:
    level = level.withColumns({
        "mid": F.expr("cast((lo + hi) div 2 as int)"),
        "total": F.expr("aggregate(of, 0L, (a, s) -> a + s.n)")})
    level = level.withColumn("places", F.expr("if(hi - lo > 1, total * (mid - lo) div (hi - lo), total)"))
    draw = F.expr("""
        aggregate(of,
          named_struct('blocks', total, 'places', places, 'out', cast(array() as array<struct<src: string, n: bigint>>)),
          (a, s) -> aggregate(if(s.n > 0, sequence(1L, s.n), cast(array() as array<bigint>)),
              named_struct('blocks', a.blocks, 'places', a.places, 'left', 0L),
              (b, k) -> if(pmod(xxhash64(node, b.blocks), 1000000007L) * 1.0D / 1000000007D * b.blocks < b.places,
                  named_struct('blocks', b.blocks - 1, 'places', b.places - 1, 'left', b.left + 1),
                  named_struct('blocks', b.blocks - 1, 'places', b.places, 'left', b.left)),
              b -> named_struct('blocks', b.blocks, 'places', b.places,
                  'out', concat(a.out, array(named_struct('src', s.src, 'n', b.left)))))).out
    """)
    drawn = level.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, draw).otherwise(F.col("of")))
    rest = F.expr("transform(of, (s, k) -> named_struct('src', s.src, 'n', s.n - left[k].n))")
    halves = F.when(F.col("hi") - F.col("lo") > 1, F.array(
        F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), (F.col("node") * 2).alias("node"), F.col("left").alias("of")),
        F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), (F.col("node") * 2 + 1).alias("node"), rest.alias("of")))
    ).otherwise(F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), (F.col("node") * 2).alias("node"), F.col("of").alias("of"))))
    return drawn.select(F.explode(halves).alias("h")).select("h.*")


def shard_of_block(tree: DataFrame, quota: DataFrame) -> DataFrame:
    """(src, block, shard): a source's blocks in hash order, dealt to the shards in runs of their quotas."""
    runs = tree.withColumn("upto", F.sum("n").over(Window.partitionBy("src").orderBy("shard")))
    places = runs.select("src", "shard", F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("rank"))
    blocks = quota.where("blocks > 0").select("src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(SEED + 1), "src", "block"), "block")
    blocks = blocks.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return blocks.join(places, ["src", "rank"]).select("src", "block", "shard")


def places(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS,
           blocks_per_shard: int = BLOCKS_PER_SHARD, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed, blocks): every document with its source's numbers and its place in each pass, and the blocks' shards.

    placed: id, src, th, bucket, seq (the two number a source's rows), size, source_size, target, goal, blocks,
    passes: array of (pass, start, upto) in words of the source's run; a pass outside the goal is left out; with
    ``carry`` also row, the whole input row.
    """
    sizes = written(_sizes(docs, id_col, source_col, text_col, False), "mix-sizes")
    goals = written(targets(sizes, weights, cap), "mix-targets")
    quota = quotas(goals, shards * blocks_per_shard)
    blocks = written(shard_of_block(splitting_tree(quota, shards), quota), "mix-blocks")
    plan = written(goals.join(quota, "src").select(
        "src", "source_size", "target", "blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / 1024)).alias("buckets"),
        F.round("target").cast("long").alias("goal")), "mix-plan")
    bucket = F.floor(F.col("u") * F.col("buckets")).alias("bucket")
    sums = sizes.join(plan, "src").groupBy("src", bucket).agg(F.sum("size").alias("words"))
    above = F.sum("words").over(Window.partitionBy("src").orderBy("bucket")) - F.col("words")
    sums = written(sums.select("src", "bucket", above.alias("first")), "mix-buckets")
    rows = _sizes(docs, id_col, source_col, text_col, True) if carry else sizes
    placed = rows.join(plan, "src").withColumn("bucket", bucket).drop("buckets").join(sums, ["src", "bucket"])
    order = Window.partitionBy("src", "bucket").orderBy("u", "id", "th")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumns({"before": F.col("first") + before, "seq": F.row_number().over(order)})
    placed = placed.withColumn("passes", F.expr(f"""
        filter(transform(sequence(0L, {cap}L), k -> named_struct('pass', cast(k as int),
            'start', k * source_size + before, 'upto', least(goal, k * source_size + before + size))), x -> x.upto > x.start)"""))
    return placed.select("id", "src", "th", "bucket", "seq", "size", "source_size", "target", "goal", "blocks", "passes",
                         *(["row"] if carry else [])), blocks


def draws(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, bucket, seq, pass, block, shard, words, and the document's numbers): what each block takes of each document.

    Block k of a source with B blocks is its words from ceil(k * goal / B) up to the next one's first.
    Documents of which nothing is taken have one row without block.
    """
    each = placed.select("src", "bucket", "seq", "id", "size", "source_size", "target", "goal", "blocks", F.explode_outer("passes").alias("x"))
    each = each.withColumn("block", F.explode_outer(F.expr("sequence(x.start * blocks div goal, (x.upto - 1) * blocks div goal)")))
    edge = "((block + {k}) * goal + blocks - 1) div blocks"
    words = F.expr(f"least(x.upto, {edge.format(k=1)}) - greatest(x.start, {edge.format(k=0)})")
    found = each.withColumn("words", words).join(blocks, ["src", "block"], "left")
    return found.select("src", "bucket", "seq", "id", "size", "source_size", "target", "x.pass", "block", "shard",
                        F.when(F.col("shard").isNotNull(), F.col("words")).alias("words"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          shard_col: str | None = None, **how) -> DataFrame:
    """The mix itself: the input's columns, a row for each pass that takes a document, in the shard of the draw's first block.

    Texts stay whole: of the last document of a source, cut by the target, a half or more counts as all
    of it, and the first one stays however long it is, so no source with a target is lost.  ``shard_col`` adds the shard.
    A shard is dealt in ``PIECES`` random pieces, so no task holds a whole one; inside, rows are in hash order.
    """
    placed, blocks = places(docs, id_col, source_col, text_col, carry=True, **how)
    each = placed.select("row", "src", "id", "th", "size", "goal", "blocks", F.explode("passes").alias("x"))
    each = each.where("(x.upto - x.start) * 2 >= size or x.start = 0")
    each = each.withColumn("block", F.expr("x.start * blocks div goal")).join(blocks, ["src", "block"])
    each = each.withColumn("slot", F.xxhash64(F.lit(SEED + 2), "id", "th", "x.pass"))
    piece = F.pmod(F.col("slot"), F.lit(PIECES))
    dealt = each.repartition("shard", piece).sortWithinPartitions("shard", "slot")
    return dealt.select("row.*", *([F.col("shard").alias(shard_col)] if shard_col else []))


def accounts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """A row a document: size, source_size, target, words taken, the shard of its first draw, and
    drawn: (pass, block, shard, words) of every draw, at most one for each block and pass of its source."""
    found = draws(*places(docs, id_col, source_col, text_col, **how))
    draw = F.when(F.col("words") > 0, F.struct("pass", "block", "shard", "words"))
    rows = found.groupBy("src", "bucket", "seq").agg(
        *[F.first(c).alias(c) for c in ("id", "size", "source_size", "target")],
        F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.array_sort(F.collect_list(draw)).alias("drawn"))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken",
                       F.get("drawn", F.lit(0)).getField("shard").alias("first_shard"), "drawn")
