"""URL lists as a Bloom filter cascade: exact membership without joins.

The keys that the corpus can ask for are its hosts' suffixes with the path
beginnings of listed lengths; their distinct set is the universe.  Level 0 of
the cascade holds the listed keys.  Level 1 holds those unlisted keys of the
universe that level 0 lets through, level 2 the listed keys that level 1 lets
through, and so on until a level lets nothing wrong through.  A key belongs to
the list if the first level that rejects it has an odd number (or if none rejects it
and the number of levels is odd): for every key of the universe that is exact.

Level 0 spends about log2(universe / list) bits a key, later ones about one and
a half, so the filters grow with the list and hardly with the corpus.
``MOST_BYTES`` bounds what is broadcast; a list beyond it is refused, not cut.
Bits are set by aggregation (bit_or of words), the driver only sees the finished words.

Keys carry their list in front: ``a|`` allow rule, ``b|`` block rule, ``d|`` blocked domain.
The longest rule that fits decides; of equally long ones the blocking one, then
the first by code point.  Where no rule fits, a url of a blocked domain is blocked and any other allowed.

Defined cases: NULL urls and urls without ``://`` have empty host and path, which no rule
and no domain fits, so they are allowed; A-Z only are lower-cased; repeated rows are judged
alike; an empty table gives no rows; an empty list blocks nothing.  Only id and url are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsgauge.sources.shared import written

MOST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_LEVELS = 40


@dataclass
class Level:
    bits: int
    hashes: int
    words: object = field(repr=False, default=None)  # numpy uint64


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def _places(n: int, k: int, level: Level, a, b):
    """Bit numbers of keys with unsigned hashes a and b for hash k of level n."""
    x = a + np.uint64(n * 64 + k + 1) * b
    x ^= x >> np.uint64(32)  # else levels of 64 bits would see the same low bits
    x *= np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) % np.uint64(level.bits)


def _reject_level(levels: list[Level]):
    """Pandas UDF: number of the first level that rejects (h1, h2); the number of levels if none does."""

    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        a, b = h1.to_numpy("int64").view("uint64"), h2.to_numpy("int64").view("uint64") | np.uint64(1)
        at = np.full(len(a), len(levels), "int32")
        left = np.arange(len(a))
        for n, level in enumerate(levels):
            inside = np.ones(len(left), bool)
            for k in range(level.hashes):
                place = _places(n, k, level, a[left], b[left])
                inside &= (level.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            at[left[~inside]] = n
            left = left[inside]
        return pd.Series(at)

    return F.pandas_udf(first, "int")


def _fill(keys: DataFrame, n: int, level: Level) -> None:
    """Set the level's bits for (h1, h2): words per batch, combined by bit_or; the driver gets the finished words."""

    def run(batches):
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False).astype("int64").view("uint64") for c in batch.columns)
            places = np.unique(np.concatenate([_places(n, k, level, a, b | np.uint64(1)) for k in range(level.hashes)]))
            words, starts = np.unique(places >> np.uint64(6), return_index=True)
            if len(words):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), starts)
                yield pa.RecordBatch.from_arrays([pa.array(words.view("int64")), pa.array(bits.view("int64"))], names=["word", "bits"])

    set_bits = keys.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    level.words = np.zeros((level.bits >> 6) + 1, "uint64")
    level.words[set_bits["word"].to_numpy("int64")] = set_bits["bits"].to_numpy("int64").view("uint64")


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe`` (both with a column key, distinct or not)."""

    def __init__(self, universe: DataFrame, listed: DataFrame):
        mark = universe.select("key", F.lit(False).alias("listed")).unionByName(listed.select("key", F.lit(True).alias("listed")))
        self.keys = written(mark.where("key is not null").groupBy("key").agg(F.max("listed").alias("listed"))
                            .select("key", "listed", *_hashes(F.col("key"))), "url-keys")
        counts = {r.listed: r["count"] for r in self.keys.groupBy("listed").count().collect()}
        self.levels: list[Level] = []
        inside, outside = counts.get(True, 0), counts.get(False, 0)
        while inside and len(self.levels) < MOST_LEVELS:
            n = len(self.levels)
            rate = 0.5 if n else min(0.5, max(1e-6, inside / max(1, outside) / math.sqrt(2)))
            hashes = max(1, round(-math.log2(rate)))
            bits = max(64, math.ceil(inside * hashes / math.log(2)))
            if bits > 8 * MOST_BYTES:
                raise ValueError(f"a filter of {bits // 8} bytes; at most {MOST_BYTES} are broadcast")
            wanted = self.keys.where(F.col("listed") == F.lit(n % 2 == 0))
            if n:
                wanted = wanted.where(_reject_level(self.levels)("h1", "h2") == n)
            level = Level(bits, hashes)
            _fill(wanted.select("h1", "h2"), n, level)
            self.levels.append(level)
            others = self.keys.where(F.col("listed") == F.lit(n % 2 == 1))
            inside, outside = others.where(_reject_level(self.levels)("h1", "h2") == n + 1).count(), inside
        if inside:
            raise ValueError("the filters do not separate the lists")

    def contains(self, key: Column) -> Column:
        if not self.levels:
            return F.lit(False)
        return _reject_level(self.levels)(*_hashes(key)) % 2 == 1


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(host: Column, path: Column, most_labels: int, lengths: list[int]) -> Column:
    """host suffixes x path beginnings of the listed lengths, longest first."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(most_labels), F.size(labels))),
                           lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    starts = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(pairs)


def judge(pages: DataFrame, block: list[str], allow: list[str], domains: DataFrame, id_col: str = "page_id",
          url_col: str = "url", most_labels: int = 4) -> DataFrame:
    """(id, host, path, rule, verdict).

    ``block`` and ``allow``: rules as host and path in one text (``org/fr/``), a configuration of the
    program; ``domains``: blocked domains as a table (domain), of any size a filter may have.  Domains of
    more than ``most_labels`` labels are refused.
    """
    for rule in (*block, *allow):
        if "/" not in rule:
            raise ValueError(f"a rule needs a path: {rule}")
    if domains.where(F.size(F.split("domain", r"\.")) > most_labels).head(1):
        raise ValueError(f"domains of more than {most_labels} labels")
    spark = pages.sparkSession
    rules = [*(("b|", r) for r in block), *(("a|", r) for r in allow)]
    lengths = sorted({len(r) - r.index("/") for _, r in rules}, reverse=True)
    rule_labels = max([1, *(r.split("/")[0].count(".") + 1 for _, r in rules)])
    rows = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    asked = rows.withColumns({
        "fits": _candidates(F.col("host"), F.col("path"), rule_labels, lengths) if rules else F.array().cast("array<string>"),
        "sites": _candidates(F.col("host"), F.lit(""), most_labels, [0])})
    universe = asked.select(F.explode(F.concat(
        F.transform("fits", lambda k: F.concat(F.lit("a|"), k)), F.transform("fits", lambda k: F.concat(F.lit("b|"), k)),
        F.transform("sites", lambda k: F.concat(F.lit("d|"), k)))).alias("key")).distinct()
    listed = domains.select(F.concat(F.lit("d|"), F.translate("domain", UPPER, LOWER)).alias("key"))
    if rules:
        listed = listed.unionByName(spark.range(1).select(F.explode(F.array(*[F.lit(a + r) for a, r in rules])).alias("key")))
    cascade = Cascade(universe, listed)

    # Every candidate is asked in place: a row's few keys become columns, so nothing is exploded or joined.
    out = asked
    found = []
    for tag in ("b|", "a|"):
        for k in range(rule_labels * len(lengths) if rules else 0):
            key = F.get("fits", F.lit(k))
            name = f"__{tag[0]}{k}"
            out = out.withColumn(name, F.when(cascade.contains(F.concat(F.lit(tag), F.coalesce(key, F.lit("")))) & key.isNotNull(), F.struct(
                F.char_length(key).alias("n"), F.lit(1 if tag == "b|" else 0).alias("blocks"), key.alias("rule"))))
            found.append(F.col(name))
    blocked = F.lit(False)
    for k in range(most_labels):
        key = F.get("sites", F.lit(k))
        blocked = blocked | (F.coalesce(cascade.contains(F.concat(F.lit("d|"), F.coalesce(key, F.lit("")))), F.lit(False)) & key.isNotNull())
    rule = F.greatest(*found) if len(found) > 1 else (found[0] if found else F.lit(None).cast("struct<n: int, blocks: int, rule: string>"))
    out = out.withColumns({"__rule": rule, "__blocked": blocked})
    verdict = F.when(F.col("__rule").isNotNull(), F.col("__rule.blocks") == 1).otherwise(F.col("__blocked"))
    return out.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"),
                      F.when(verdict, "block").otherwise("allow").alias("verdict"))
