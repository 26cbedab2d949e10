"""What the corpus operators share: word definition, folds, bounded samples, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word: a run of anything but ASCII white space.  ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Output rows and text bytes after which a Python task hands a batch back to Spark.
OUT_ROWS, OUT_BYTES = 2000, 8 << 20


def table(spark, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; NULL ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: str) -> DataFrame:
    """At most ``rows`` labelled documents of the learning folds: (doc_id, text, label).

    The rows with the smallest id hashes are taken, so the choice neither
    depends on the layout nor on the run.  Only ids of the sample are broadcast:
    two numbers for each of at most ``rows`` rows.  NULL labels and NULL ids teach nothing.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
              .where((fold(F.col("doc_id")) != 0) & F.col("label").isin(0, 1))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(order, "doc_id").limit(rows))
    pairs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return pairs.limit(rows)  # ids may repeat among the documents


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., Iterator[tuple] | tuple]],
             many: bool = False) -> DataFrame:
    """``start()`` runs once a task and returns the function of a row's values.

    With ``many`` it yields any number of rows.  Batches are cut by rows and by
    bytes of text read, so a run of very long texts does not pile up.
    """
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        fn = start()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            columns = batch.columns
            step = max(1, min(batch.num_rows, 512))
            for at in range(0, batch.num_rows, step):
                for values in zip(*(c.slice(at, step).to_pylist() for c in columns), strict=True):
                    got = fn(*values)
                    rows.extend(got) if many else rows.append(got)
                    size += sum(len(v) for v in values if isinstance(v, (str, bytes, list)))
                    if len(rows) >= OUT_ROWS or size >= OUT_BYTES:
                        if rows:  # with ``many`` much text may give no row
                            yield as_batch(rows, arrow)
                        rows, size = [], 0
        if rows:
            yield as_batch(rows, arrow)

    return df.mapInArrow(run, out)


def as_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
