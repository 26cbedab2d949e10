"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The binary
Golay code of length 23 is perfect: every 23-bit word lies within 3 bits of
exactly one codeword.  The keys of a segment are the 12-bit indices of the
codewords to which the words at distance 0 or 1 decode: one to six of them.
Two segments at most 2 bits apart have a word within 1 bit of both and
therefore a key in common.

Of two errors in three segments at least one segment has none (pigeonhole), so a
fingerprint gets, for each segment, the exact segment with every key of the next one.
Fingerprints are joined on these keys and the pairs verified by their differing bits.  A key that more than
``CROWD`` fingerprints share is not joined: its fingerprints are linked through the words half-way.  Two of them are
at most 2 bits apart exactly if a word is within 1 bit of both, and all that share such a word (at most 65) are
linked to the smallest of them.  This connects what all pairs would, with rows that grow as the fingerprints.

Components are found on distinct fingerprints by taking the smallest label of
the neighbours and following labels, until nothing changes.

Defined cases: a NULL or wordless text has fingerprint zero and is linked like any
other; repeated rows stay rows of their own in one component; a NULL id is
never the smallest unless the component has no other, then it is NULL; the
empty table gives no rows; a text of any length is read whole.  Only the id and
text columns are read.  Nothing is broadcast by hint, no group is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.llm.common import map_rows
from obsgauge.sources.shared import written

SHINGLE = 3
SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
#: Generator polynomial of the code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Up to so many fingerprints of a key are joined with each other; the rest is linked through half-way words.
CROWD = 64


def _rest(word: int) -> int:
    """Remainder of a 23-bit word by the generator: its syndrome."""
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


class Golay:
    """Syndrome decoding of arrays of 23-bit words."""

    def __init__(self):
        import itertools

        import numpy as np

        self.np = np
        self.low = np.array([_rest(b) for b in range(1 << 12)], "int64")
        self.high = np.array([_rest(b << 12) for b in range(1 << 11)], "int64")
        self.error = np.zeros(1 << 11, "int64")
        for n in (1, 2, 3):
            for bits in itertools.combinations(range(23), n):
                pattern = sum(1 << b for b in bits)
                self.error[_rest(pattern)] = pattern
        self.near = np.array([0, *(1 << b for b in range(23))], "int64")

    def index(self, words):
        """The index (upper 12 bits) of the codeword within 3 bits."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.error[syndrome]) >> 11

    def keys(self, words):
        """(n, 24) indices to which each word and its 23 neighbours decode, repeats included."""
        return self.index(words[:, None] ^ self.near[None, :])


def fingerprint_of():
    """The function of a text that gives its 64-bit SimHash as a signed integer."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_digest
    steps = 1 << 14

    def simhash(text):
        words = (text or "").encode().lower().split()  # both only touch ASCII
        if not words:
            return 0
        if len(words) < SHINGLE:
            shingles = [b" ".join(words)]
        else:
            shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
        total = np.zeros(64, "int64")
        for at in range(0, len(shingles), steps):
            hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles[at:at + steps]]), "uint8").reshape(-1, 8)
            total += np.unpackbits(hashes, axis=1).sum(axis=0, dtype="int64")
        bits = np.packbits(total * 2 > len(shingles))
        return int.from_bytes(bits.tobytes(), "big", signed=True)

    return simhash


def simhash_of(hashes) -> int:
    """The 64-bit SimHash of a set of hashed shingles (an array of 64-bit numbers) as a signed integer."""
    import numpy as np

    total = np.zeros(64, "int64")
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at:at + (1 << 14)].astype(">u8").view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, fp): the SimHash of every row."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def start():
        simhash = fingerprint_of()
        return lambda text, *kept: (*kept, simhash(text))

    return map_rows(docs.select(text_col, *keep), ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "fp bigint"]), start)


def golay_keys(distinct: DataFrame) -> DataFrame:
    """(fp, key): for each segment, itself exactly with each Golay key of the next segment."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        code = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("int64")
            for at in range(0, len(fps), 4096):
                part = fps[at:at + 4096]
                plain = part.view("uint64")
                cut = [((plain >> np.uint64(first)) & np.uint64((1 << n) - 1)).astype("int64") for first, n in SEGMENTS]
                rows, keys = [], []
                for k in range(len(SEGMENTS)):
                    fuzzy = np.sort(code.keys(cut[(k + 1) % len(SEGMENTS)]), axis=1)
                    fresh = np.ones(fuzzy.shape, bool)
                    fresh[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
                    owner, column = np.nonzero(fresh)
                    rows.append(part[owner])
                    keys.append((k << 40) | (cut[k][owner] << 12) | fuzzy[owner, column])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys))], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp bigint, key bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links among distinct fingerprints at most 2 bits apart, both directions, connecting as all pairs would."""
    keys = golay_keys(distinct)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sharing = written(keys.join(sizes, "key").select("key", "fp", "n"), "golay-keys")
    few = sharing.where(F.col("n") <= CROWD)
    one, other = (few.select("key", F.col("fp").alias(c)) for c in "ab")
    joined = one.join(other, "key").where("a > b and bit_count(a ^ b) <= 2").select("a", "b")
    crowded = sharing.where(F.col("n") > CROWD).select("fp").distinct()
    half_way = crowded.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("mid"))
    hub = half_way.withColumn("hub", F.min("fp").over(Window.partitionBy("mid")))
    star = hub.where("fp <> hub and bit_count(fp ^ hub) <= 2").select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    found = joined.unionByName(star).distinct()
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.a", "x.b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b; both directions) can reach.

    A round takes the smallest label of the neighbours, then the label's label.
    Every round's table is written to the shared folder.
    """
    edges = written(edges, "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        step = written(step, "labels")
        onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = written(step.join(onward, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")


def grouped(distinct: DataFrame) -> DataFrame:
    """(fp, label, ...) for a table of distinct fingerprints: rows of one label can reach each other by links."""
    labels = components(links(distinct))
    return distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): the smallest id that a row's fingerprint can reach by links, itself included."""
    own = written(fingerprints(docs, text_col, (id_col,)), "fingerprints")
    groups = grouped(written(own.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct"))
    smallest = groups.groupBy("label").agg(F.min("least").alias("component"))
    answer = written(groups.join(smallest, "label").select("fp", "component"), "components")
    return own.join(answer, "fp").select(id_col, "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id (then text hash) of each component, with all its columns; of equal rows one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(1), id_col, text_col).alias("k1"),
                       F.xxhash64(F.lit(2), text_col, id_col).alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = fingerprints(rows, "text", ("id", "k1", "k2"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("best")
    groups = grouped(written(own.groupBy("fp").agg(best), "distinct"))
    stay = written(groups.groupBy("label").agg(F.min("best").alias("best")).select("best.k1", "best.k2"), "representatives")
    return rows.select("row", "k1", "k2").join(stay, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint as 16 hex digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
