"""Near-duplicates by an LSH forest over the sets of two-word shingles: Jaccard >= 0.8.

A document's signature has ``TREES`` rows of ``DEPTH`` minima of its hashed shingles; each row is the path of
the document in one tree.  Sorting a tree's paths puts documents next to each other that agree in a long prefix, and
two sets of likeness J agree in the first d minima with probability J ** d.

* Regions.  The paths that share their first ``SHALLOW`` minima are one region.  A region of more than ``CROWD`` documents is
  divided by one more minimum, and again, until it is small enough: so the depth follows the density of each region.
  What is still larger at full depth, almost equal sets, is divided by a hash of the document.
* Candidates.  First the neighbours in a region's sorted order, which share its longest prefixes, in
  one tree, then in a few more, then in all; confirmed links join documents to components, and pairs inside a component need no
  more work.  Then every pair of a region that was not divided, in every tree, that lies in two components, unless too few of all
  their minima agree.
* Crowded regions exactly.  A pair that a division has parted lies, with its whole sets, in a region that was crowded at the first depth.
  The documents of those of these regions that hold two components or more are joined on their rarest shingles: two sets
  of n and m shingles that are alike share at least t = 4 / 9 * (n + m), so in one order of all shingles the first that
  they share has t or more of either set from it on.  A set is listed under its first fifth only, and pairs are
  compared unless they lie in one component or too little of a set is left; no pair at 0.8 is lost.  The order, commonest last,
  is of consequence for the work only.  The smaller set of a pair has the shingle in its first ninth: a shingle that no set has there is left out,
  such as that of a frame around more than a ninth of own shingles.  A shingle of many sets is joined in pieces.  Its largest component
  is dealt out to them and the others are copied, so a group of near copies costs no copy, and a piece's copies are a few for each
  ``PIECE`` pairs in two components.  A pair is a candidate unless sketches prove it unlike: bits that say whether an odd number
  of a set's shingles fall on them, so two sets differ in as many shingles at least as their sketches do in bits.
* Links are confirmed on the full sets (100 * intersection >= 80 * union).

Documents with equal sets are one node from the start.  A group of near copies costs about a pair a node in the first
rounds and none in the last, and a node has at most ``CROWD`` candidates a tree before the crowded regions are joined.  A pair at 0.8
shares no region of any tree with probability (1 - 0.8 ** 3) ** 24 = 3e-8 (closer pairs far less often).

Defined cases: words are cut at ASCII white space and compared in lower case (ASCII); a single word is a set of one; NULL and
wordless texts have the empty set and are linked with nothing, not even each other; repeated rows are rows of one
component; a NULL id is the component only where no member has an id, and such rows are kept; an empty table gives no rows; texts are read whole; only the
id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.llm.common import map_rows
from obsgauge.llm.golay import components, simhash_of
from obsgauge.sources.shared import written

SHINGLE = 2
PERCENT = 80
TREES, SHALLOW, DEPTH = 24, 3, 7
CROWD = 64
#: Of the ``TREES * DEPTH`` minima, as many as a pair at 0.8 has in common but for 4.5 standard deviations (3e-6).
AGREEING = 111
#: Rounds of candidates: the trees, and whether all pairs of an undivided region are compared or the sorted neighbours of every region.
ROUNDS = ((range(0, 1), False), (range(1, 4), False), (range(4, TREES), False), (range(0, TREES), True))
#: Shingles whose number of sets is known to the order of all shingles (4 MB); the rest counts as rarer than these.
COMMON = 1 << 18
#: Rows of a rare shingle that are joined at once; the rows of a larger one are dealt out to pieces.
PIECE = 1024
#: 64-bit words of a sketch.
WORDS = 16
#: Up to so many rows of three numbers each (16 MB) are broadcast to fetch their texts; beyond, both sides are shuffled.
FETCHED_AT_ONCE = 200_000
SEED = 12


def hashed_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()  # both only touch ASCII
    if len(words) < shingle:
        found = {b" ".join(words)} if words else set()
    else:
        found = set(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    out = np.fromiter(map(xxhash.xxh64_intdigest, found), "uint64", len(found))
    out.sort()
    return out


def signer():
    """The function of a hashed set that gives its paths: ``TREES`` times ``DEPTH`` minima of 16 bits."""
    draw = np.random.default_rng(SEED)
    factor = draw.integers(0, 1 << 32, TREES * DEPTH, dtype="uint64").astype("uint32") | np.uint32(1)
    shift = draw.integers(0, 1 << 32, TREES * DEPTH, dtype="uint64").astype("uint32")

    def paths(hashes):
        short = (hashes >> np.uint64(32)).astype("uint32")
        least = np.full(TREES * DEPTH, np.iinfo("uint32").max, "uint32")
        for at in range(0, len(short), 1024):
            least = np.minimum(least, (short[at:at + 1024, None] * factor + shift).min(axis=0))
        return least.astype("uint16").tobytes()

    return paths


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, k1, k2): equal rows have equal keys."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.select("id", "text", F.xxhash64(F.lit(1), "id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "id").alias("k2"))


def signed(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, k1, k2, n, name, paths, fp) of (id, text, k1, k2): set size, hash of the set, its signature and its SimHash; NULL for the empty set."""
    kind = rows.schema["id"].dataType.simpleString()

    def start():
        paths = signer()

        def sign(text, *kept):
            hashes = hashed_set(text, shingle)
            if not len(hashes):
                return *kept, 0, None, None, None
            return *kept, len(hashes), xxhash.xxh128_digest(hashes.tobytes()), paths(hashes), simhash_of(hashes)

        return sign

    return map_rows(rows.select("text", "id", "k1", "k2"), f"id {kind}, k1 bigint, k2 bigint, n bigint, name binary, paths binary, fp bigint", start)


def _key(depth: int) -> Column:
    return F.xxhash64(F.lit(depth), "tree", F.substring("path", 1, 2 * depth))


def _shared(rows: DataFrame, depth: int) -> DataFrame:
    rows = rows.withColumn("key", _key(depth))
    shared = rows.groupBy("key").agg(F.count("*").alias("crowd")).where("crowd > 1")
    return written(rows.join(shared, "key").select("key", "crowd", "tree", "path", "node", "n"), "regions")


def undivided(nodes: DataFrame) -> DataFrame:
    """(key, crowd, tree, path, node, n): the regions of all trees with two nodes or more at the first depth."""
    spot = F.substring(F.col("paths"), F.col("tree") * 2 * DEPTH + 1, F.lit(2 * DEPTH))
    rows = nodes.select("node", "n", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("node", "n", "tree", spot.alias("path"))
    return _shared(rows, SHALLOW)


def regions(nodes: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(key, tree, path, node, n): the regions of all trees with two nodes or more, each as deep as its density asks for; ``whole``: ``undivided`` of the nodes."""
    part, found = undivided(nodes) if whole is None else whole, None
    for depth in range(SHALLOW, DEPTH + 1):
        if depth > SHALLOW:
            part = _shared(rows, depth)
        small = part.where(F.col("crowd") <= CROWD)
        crowded = part.where(F.col("crowd") > CROWD)
        if depth == DEPTH:  # almost equal sets
            pieces = F.ceil(F.col("crowd") / CROWD)
            small = small.unionByName(crowded.withColumn("key", F.xxhash64("key", F.pmod(F.xxhash64("node"), pieces))))
        small = small.drop("crowd")
        found = small if found is None else found.unionByName(small)
        if crowded.isEmpty():
            break
        rows = crowded.drop("key", "crowd")
    return found


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("label", F.col("node"))
    named = labels.withColumnRenamed("label", "found")
    return members.join(named, "node", "left").withColumn("label", F.coalesce("found", "node")).drop("found")


def _sizes_fit(a: Column, b: Column) -> Column:
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def neighbours(members: DataFrame) -> DataFrame:
    """(a, b): neighbours in the sorted order of each region that lie in two components."""
    order = Window.partitionBy("key").orderBy("path", "node")
    before = {c: F.lag(c).over(order) for c in ("node", "label", "n")}
    pairs = members.select("node", "label", "n", *[before[c].alias(f"{c}_before") for c in before])
    pairs = pairs.where((F.col("label") != F.col("label_before")) & _sizes_fit(F.col("n"), F.col("n_before")))
    return pairs.select(F.least("node", "node_before").alias("a"), F.greatest("node", "node_before").alias("b")).distinct()


def crossings(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): all pairs of a region that lie in two components and agree in most minima; a region has about ``CROWD`` nodes at most."""
    open_regions = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    apart = members.join(open_regions, "key").select("key", "node", "label", "n").join(nodes.select("node", "paths"), "node")
    columns = ("node", "label", "n", "paths")
    lists = apart.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("of")).select(*[F.col(f"of.{c}") for c in columns])

    def start():
        def pairs(node, label, n, paths):
            minima = np.frombuffer(b"".join(paths), "uint16").reshape(len(node), -1)
            node, label, n = np.array(node), np.array(label), np.array(n)
            for k in range(len(node)):
                fit = (node > node[k]) & (label != label[k]) & (100 * np.minimum(n, n[k]) >= PERCENT * np.maximum(n, n[k]))
                other = np.nonzero(fit)[0]
                other = other[(minima[other] == minima[k]).sum(axis=1) >= AGREEING]
                yield from ((int(node[k]), int(x)) for x in node[other])

        return pairs

    return map_rows(lists, "a bigint, b bigint", start, many=True).distinct()


def parted(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the (key, node) whose region holds two components or more."""
    members = _labelled(crowded, labels)
    open_regions = written(members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key"), "open-regions")
    few = open_regions.count() <= FETCHED_AT_ONCE  # a region of many nodes then stays where its rows are
    return members.join(F.broadcast(open_regions) if few else open_regions, "key").select("node", "label").distinct()


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and in about how many sets each is; those met once in a batch are not counted."""

    def run(batches):
        for batch in batches:
            hashes, times = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "int64"), return_counts=True)
            often = times > 1
            yield pa.RecordBatch.from_arrays([pa.array(hashes[often]), pa.array(times[often])], names=["shingle", "times"])

    counts = sets.select("hashes").mapInArrow(run, "shingle bigint, times bigint").groupBy("shingle").agg(F.sum("times").alias("times"))
    found = counts.orderBy(F.desc("times"), "shingle").limit(COMMON).toArrow().sort_by("shingle")
    return found["shingle"].to_numpy(), found["times"].to_numpy()


def rarest(sets: DataFrame) -> DataFrame:
    """(shingle, node, label, n, rest): the rarest shingles of each (node, label, hashes), with the set's size and how much of it comes from each on."""
    shingles, times = common_shingles(sets)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                node, label, hashes = (c.slice(at, 512) for c in batch.columns)
                kept, rest = [], []
                for one in hashes:
                    one = np.frombuffer(one.as_buffer(), "int64")
                    often = np.zeros(len(one), "int64")
                    if len(shingles):
                        spot = np.minimum(np.searchsorted(shingles, one), len(shingles) - 1)
                        often = np.where(shingles[spot] == one, times[spot], 0)
                    kept.append(one[np.lexsort((one, often))][:(100 - PERCENT) * len(one) // 100 + 1])
                    rest.append(len(one) - np.arange(len(kept[-1])))
                many = [len(x) for x in kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept)), pa.array(np.repeat(node.to_numpy(zero_copy_only=False), many)),
                                                  pa.array(np.repeat(label.to_numpy(zero_copy_only=False), many)),
                                                  pa.array(np.repeat([x[0] for x in rest], many)), pa.array(np.concatenate(rest))],
                                                 names=["shingle", "node", "label", "n", "rest"])

    return sets.select("node", "label", "hashes").mapInArrow(run, "shingle bigint, node bigint, label bigint, n bigint, rest bigint")


def rare_regions(listed: DataFrame) -> DataFrame:
    """(shingle, main, crowd) of the listed shingles that a pair can have as its first in common: the largest component's label and the number of rows."""
    parts = listed.groupBy("shingle", "label").agg(F.count("*").alias("rows"), F.max(F.col("rest") * (100 + PERCENT) >= F.col("n") * 2 * PERCENT).alias("leads"))
    largest = F.max(F.struct("rows", "label"))
    return parts.groupBy("shingle").agg(largest.getField("label").alias("main"), F.sum("rows").alias("crowd"), F.count("*").alias("parts"), F.max("leads").alias("leads")).where(
        "parts > 1 and leads").select("shingle", "main", "crowd")


def sketched(sets: DataFrame) -> DataFrame:
    """(node, w0, w1, ...): for each of 64 * ``WORDS`` values of a hash's first bits, whether an odd number of the set's hashes have it."""
    shift = np.uint64(64 - (64 * WORDS - 1).bit_length())

    def start():
        def sketch(node, hashes):
            odd = np.bincount((np.frombuffer(hashes, "uint64") >> shift).astype("int64"), minlength=64 * WORDS) & 1
            return node, *np.packbits(odd.astype(bool)).view("int64").tolist()

        return sketch

    return map_rows(sets.select("node", "hashes"), "node bigint, " + ", ".join(f"w{k} bigint" for k in range(WORDS)), start)


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of rows with a shingle, its main and crowd: every row in a piece of its shingle, those outside of the largest component in all."""
    pieces = F.ceil(F.col("crowd") / PIECE)
    one = rows.withColumn("piece", F.pmod(F.xxhash64("node"), pieces))
    other = rows.where("label <> main").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return one, other.select("shingle", "piece", *[F.col(c).alias(f"{c}_other") for c in rows.columns if c not in ("shingle", "main", "crowd")])


def sharing_rare(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): all pairs of the (node, label) in two components whose sets can be alike by the first of their rarest shingles that they share and by their sketches."""
    own = sets.join(apart, "node")
    listed = written(rarest(own), "rarest")
    shared = written(listed.join(rare_regions(listed), "shingle"), "rarest-shared")
    one, other = dealt(shared.join(written(sketched(own), "sketches"), "node"))
    once = (F.col("label") == F.col("main")) | (F.col("node") < F.col("node_other"))
    both = F.col("n") + F.col("n_other")
    fits = (100 + PERCENT) * F.least("rest", "rest_other") >= PERCENT * both
    bits = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"w{k}_other"))) for k in range(WORDS)), F.lit(0))
    pairs = one.join(other, ["shingle", "piece"]).where((F.col("label") != F.col("label_other")) & once & fits & ((100 + PERCENT) * bits <= (100 - PERCENT) * both))
    return pairs.select(F.least("node", "node_other").alias("a"), F.greatest("node", "node_other").alias("b")).distinct()


def sets_of(rows: DataFrame, chosen: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, hashes): the full sets of the chosen (node, k1, k2), from one row each."""
    few = chosen.count() <= FETCHED_AT_ONCE
    texts = rows.join(F.broadcast(chosen) if few else chosen, ["k1", "k2"]).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))

    def start():
        return lambda node, text: (node, hashed_set(text, shingle).tobytes())

    return map_rows(texts, "node bigint, hashes binary", start)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are alike."""

    def run(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                one, other = (np.frombuffer(x.as_buffer(), "uint64") for x in (one, other))
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(one) + len(other) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("other")), "b"))
    return both.select("a", "b", "one", "other").mapInArrow(run, "a bigint, b bigint")


def linked(nodes: DataFrame, rows: DataFrame, shingle: int = SHINGLE, first: DataFrame | None = None) -> DataFrame:
    """(node, label) of the nodes with a link; ``nodes``: (node, n, paths, k1, k2), one for each set; ``first``: candidates (a, b) confirmed before the others."""
    whole = undivided(nodes)
    members, crowded = regions(nodes, whole), whole.where(F.col("crowd") > CROWD).select("key", "node")
    small = whole.where(F.col("crowd") <= CROWD).drop("crowd")
    asked = members.select("node").unionByName(crowded.select("node"))
    if first is not None:
        asked = asked.unionByName(first.select(F.explode(F.array("a", "b")).alias("node")))
    suspects = nodes.join(asked.distinct(), "node").select("node", "k1", "k2")
    sets = written(sets_of(rows, written(suspects, "suspects"), shingle), "sets")
    edges, labels = None, None
    if first is not None:
        edges = written(confirmed(first, sets), "links")
        labels = components(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    for trees, all_pairs in ROUNDS:
        part = _labelled(small if all_pairs else members.where(F.col("tree").between(trees[0], trees[-1])), labels)
        links = written(confirmed(crossings(part, nodes) if all_pairs else neighbours(part), sets), "links")
        if links.isEmpty() and labels is not None:
            continue
        edges = links if edges is None else edges.unionByName(links)
        labels = components(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    apart = written(parted(crowded, labels), "parted")
    if not apart.isEmpty():
        links = written(confirmed(written(sharing_rare(apart, sets), "rare-pairs"), sets), "links")
        if not links.isEmpty():
            edges = edges.unionByName(links)
            labels = components(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component): the smallest id that a row can reach by links, itself included."""
    rows = row_keys(docs, id_col, text_col)
    own = written(signed(rows), "signatures")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("best")
    sets = own.where("name is not null").groupBy("name").agg(best, F.first("n").alias("n"), F.first("paths").alias("paths"))
    nodes = written(sets.withColumn("node", F.monotonically_increasing_id()), "nodes")  # a short name, fixed as it is written
    found = linked(nodes.select("node", "n", "paths", "best.k1", "best.k2"), rows)
    groups = nodes.select("node", "name", "best").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = groups.groupBy("label").agg(F.min("best").alias("least")).select("label", F.col("least.id").alias("component"))
    answer = written(groups.join(smallest, "label").select("name", "component"), "components")
    placed = own.where("name is not null").select("id", "n", "name").join(answer, "name").select("id", "n", "component")
    alone = own.where("name is null").select("id", "n", F.col("id").alias("component"))
    return placed.unionByName(alone).select("id", F.col("n").alias("n_shingles"), "component")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
                                        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
