"""Quality by nearest-neighbour voting among latent-semantic vectors.

1. Terms.  A text's bytes are mapped to classes (lower, upper, digit, space, line end, each
   punctuation mark), runs of a class are folded, and runs of three classes are
   hashed to terms; so are the bytes themselves in threes; a few terms count structure: repeated words, repeated lines, variety.
2. Latent-semantic vectors.  Counts are damped, weighted by rarity in the
   sample, each kind scaled to its share, and projected on the sample's leading singular vectors.
3. Vote.  The labelled vectors (at most ``SAMPLE_ROWS`` rows of ``DIMENSIONS``
   numbers) go with every task; the cosines of a block of documents with all of them are one
   exact matrix product, and the ``NEIGHBOURS`` nearest vote with the cosine as weight.

Defined cases: NULL and empty texts have no vector and get the share of good labels in the
sample; texts are read whole; ties among neighbours at the last place are
broken by the order of the labelled rows; repeated rows and NULL ids are scored row by row; without labels of
both kinds every score is the share of good ones (0.5 without any); an empty
table gives no rows.  Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.llm.common import held_out, labelled_sample, map_rows
from obsgauge.sources.shared import written

SAMPLE_ROWS = 4096
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.3
SHAPE_TERMS, BYTE_TERMS = 768, 256
SHARES = (0.5, 0.1, 0.4)  # of shapes, bytes, structure in a vector's length
BLOCK = 256


def _classes():
    table = np.zeros(256, "int64")
    table[ord("a"):ord("z") + 1] = 1
    table[128:] = 1
    table[ord("A"):ord("Z") + 1] = 2
    table[ord("0"):ord("9") + 1] = 3
    for k, c in enumerate(c for c in range(33, 127) if not chr(c).isalnum()):
        table[c] = 5 + k
    table[ord("\n")] = 4
    return table


CLASSES = _classes()
STRUCTURE = 6


def _bucket(a, b, c, n: int):
    mixed = (a * 0x1F1F1 + b) * 0x9E3B1 + c
    return ((mixed ^ (mixed >> 13)) * 0x5BD1E995 >> 7) % n


def terms(text: str | None):
    """Damped counts of the terms of a text as one float32 row; None without a word."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return None
    row = np.zeros(SHAPE_TERMS + BYTE_TERMS + STRUCTURE, "float32")
    data = np.frombuffer(raw, "uint8")
    kinds = CLASSES[data]
    folded = kinds[np.concatenate([[True], kinds[1:] != kinds[:-1]])]
    for values, n, at in ((folded, SHAPE_TERMS, 0), (data.astype("int64"), BYTE_TERMS, SHAPE_TERMS)):
        values = np.concatenate([[0], values, [0]])
        counts = np.bincount(_bucket(values[:-2], values[1:-1], values[2:], n), minlength=n)
        row[at:at + n] = np.sqrt(counts)
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(map(bytes.__eq__, words, words[1:]))
    letters = np.count_nonzero((kinds == 1) | (kinds == 2))
    row[-STRUCTURE:] = (1.0, 4 * (same / n) ** 0.5, 2 * (1 - len(set(lines)) / len(lines)) ** 0.5,
                        4 * (np.count_nonzero(kinds > 4) / len(data)) ** 0.5, 2 * (np.count_nonzero(kinds == 2) / max(1, letters)) ** 0.5,
                        1 - len(set(words)) / n ** 0.95 if n > 1 else 0.0)
    return row


class Model:
    """Weights, projection and labelled vectors; bounded by the sample's size, not by the corpus."""

    def __init__(self, rows, labels):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.vectors = None
        if len(labels) and 0 < labels.sum() < len(labels):
            self.weights = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1).astype("float32")
            weighted = self._weighted(rows)
            _, vectors = np.linalg.eigh(weighted.T @ weighted)  # right singular vectors, largest last
            self.projection = np.ascontiguousarray(vectors[:, -DIMENSIONS:]).astype("float32")
            self.vectors = self._unit(weighted @ self.projection)
            self.labels = labels.astype("float32")

    def _weighted(self, rows):
        out = rows * self.weights
        cuts = (0, SHAPE_TERMS, SHAPE_TERMS + BYTE_TERMS, rows.shape[1])
        for share, a, b in zip(SHARES, cuts, cuts[1:], strict=False):
            out[:, a:b] *= share / np.maximum(np.linalg.norm(out[:, a:b], axis=1, keepdims=True), 1e-6) if b < rows.shape[1] else share / 2
        return out

    @staticmethod
    def _unit(rows):
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)

    def scores(self, rows):
        """Share of the good among the nearest labelled rows, weighted by the cosine."""
        if self.vectors is None:
            return np.full(len(rows), self.share)
        cosines = self._unit(self._weighted(rows) @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** 8 + 1e-9
        return (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, "quality", sample_rows, "neighbours")

    def start():
        def row(key, text, label):
            got = terms(text)
            return key, None if got is None else got.astype("float16").tobytes(), label

        return row

    rows = written(map_rows(sample.select(F.col("doc_id").cast("string"), "text", "label"), "id string, x binary, label int", start), "terms")
    got = rows.where("x is not null").orderBy("id", "x").collect()
    width = SHAPE_TERMS + BYTE_TERMS + STRUCTURE
    x = np.array([np.frombuffer(r.x, "float16") for r in got], "float32").reshape(-1, width)
    return Model(x, np.array([r.label for r in got], "float32"))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, row by row, in blocks."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most SAMPLE_ROWS x DIMENSIONS numbers and the projection

    def run(batches):
        own = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = [terms(t) for t in part.column(1).to_pylist()]
                score = np.full(len(rows), own.share)
                some = [k for k, r in enumerate(rows) if r is not None]
                if some:
                    score[some] = own.scores(np.stack([rows[k] for k in some]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype("float64"))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs, fit(docs, labels, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
