"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: each is the longest phrase met
before, and one more character.  Texts that would compress each other share
phrases.  The set of phrases is hashed, and the smallest hash under each of
``SLOTS`` permutations is kept, 16 bits of it.  The likeness of two fingerprints is the share
of equal slots: an estimate of the share of common phrases.

The whole set is hashed whatever the length of the text or of its phrases, so what
likeness rests on never changes with the size of a text or its script.

``neighbours`` compares a text with an edited text (its second half replaced by
the beginning of the next text in the order of the ids) and with the next
text.  Rows are dealt by ranges of the id and sorted inside; a task reads its range
once, row by row, holding two texts.  Only the first and last text of each range
cross ranges: they are written with the results and joined range to range.

Defined cases: a NULL text is the empty one; an empty text has the fingerprint of
no phrases, equal to that of any other empty text; equal texts have equal fingerprints;
NULL ids come first, equal ids in the order of their texts; after the last text comes the
first; one row alone is its own next; an empty table gives no rows.  Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from obsgauge.llm.common import as_batch, map_rows
from obsgauge.sources.shared import written

SLOTS = 64
SHORTEST = 4  # characters from which a phrase is seldom common to a language; nothing is left out by it
SEED = 5


class Phrases:
    """The phrases of a text so far; parsing can go on from a copy."""

    __slots__ = ("found", "open")

    def __init__(self, found=None, open_=""):
        self.found, self.open = found if found is not None else set(), open_

    def read(self, text: str) -> Phrases:
        found, phrase, add = self.found, self.open, self.found.add
        for c in text:
            phrase += c
            if phrase not in found:
                add(phrase)
                phrase = ""
        self.open = phrase
        return self

    def copy(self) -> Phrases:
        return Phrases(set(self.found), self.open)


class Signer:
    def __init__(self, slots: int = SLOTS):
        import numpy as np

        draw = np.random.default_rng(SEED)
        self.np = np
        self.factor = draw.integers(1, 1 << 63, slots, dtype="uint64") | np.uint64(1)
        self.shift = draw.integers(0, 1 << 63, slots, dtype="uint64")
        self.slots = slots

    def signature(self, phrases: Phrases):
        """Slots of 16 bits; of no phrases all ones."""
        import pandas as pd

        np = self.np
        words = list(phrases.found) or ([phrases.open] if phrases.open else [])
        if not words:
            return np.full(self.slots, 0xFFFF, "uint16")
        hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
        least = np.full(self.slots, np.iinfo("uint64").max, "uint64")
        for at in range(0, len(hashes), 4096):
            mixed = hashes[at:at + 4096, None] * self.factor + self.shift
            least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
        return (least >> np.uint64(40)).astype("uint16")

    def of(self, text: str):
        return self.signature(Phrases().read(text))


def as_text(signature) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a, b) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many characters of the following one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class Reader:
    """Rows of a text and its next; the next's phrases are read once."""

    def __init__(self):
        self.signer = Signer()
        self.ahead = None  # (text, signature) of the text read as the next one

    def row(self, key, text: str, following: str):
        from hashlib import sha256

        half = len(text) // 2
        stem = Phrases().read(text[:len(text) - half])
        change = self.signer.signature(stem.copy().read(following[:half]))
        if self.ahead and self.ahead[0] == text:
            own = self.ahead[1]
        else:
            own = self.signer.signature(stem.read(text[len(text) - half:]))
        after = own if following == text else self.signer.of(following)
        self.ahead = (following, after)
        return (key, len(text), sha256(edited(text, following).encode()).hexdigest(), as_text(own), as_text(change),
                likeness(own, change), likeness(own, after))


RESULT = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"part int, end string, text string, id {kind}, {RESULT}"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id", F.col("text").substr(1, 64)).sortWithinPartitions("id", "text")
    dealt = dealt.withColumn("part", F.spark_partition_id())

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        reader, before, out = Reader(), None, []

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for key, text, part in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns), strict=True):
                    if before is None:
                        out.append((part, "first", text, key, *[None] * 6))
                    else:
                        out.append((part, None, None, *reader.row(before[0], before[1], text)))
                    before = (key, text, part)
                if len(out) >= 512:
                    yield as_batch(out, arrow)
                    out.clear()
        if before is not None:
            out.append((before[2], "last", before[1], before[0], *[None] * 6))
            yield as_batch(out, arrow)

    made = written(dealt.mapInArrow(run, schema), "neighbours")
    ends = made.where("end is not null")
    order = Window.orderBy("part")
    parts = written(ends.where("end = 'first'").select("part").withColumns({
        "after": F.lead("part").over(order), "least": F.min("part").over(Window.partitionBy())})
        .select("part", F.coalesce("after", "least").alias("after")), "ranges")
    last = ends.where("end = 'last'").select("part", "id", "text").join(parts, "part")
    first = ends.where("end = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))

    across = map_rows(last.join(first, "after").select("id", "text", "following"), f"id {kind}, {RESULT}", lambda: Reader().row)
    return made.where("end is null").drop("part", "end", "text").unionByName(across).withColumnRenamed("id", id_col)
