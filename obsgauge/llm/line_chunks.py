"""Removal of repeated passages by content-defined chunks of lines.

Lines that hold a word are hashed.  Two kinds of chunks are formed per document:

* content-defined: a line ends a chunk when the rolling hash over it and the
  line before is 0 modulo ``divisor``.  The cut depends on two lines only, so
  chunks find each other again after insertions above.  Chunks of one line or
  of under ``least_words`` words are not compared.
* anchored: at every line, the shortest run from there and the shortest run up to
  there with ``passage_words`` words.  A passage shorter than about two content-defined chunks may contain
  no whole one; it does contain the anchored run of its first line.  The mirrored
  run is the shortest with as many words that ends at the line: the last lines of a
  passage start no run inside it, but the run that ends at its last line covers them.
  So every line of a passage of whole lines with that many words is found wherever it stands.

Chunks are compared by two 64-bit hashes over all documents; those that occur
again are compared byte by byte with their first occurrence (smallest id, then
place), and lines covered by a later occurrence are removed.  Every removed line
is still there at an earlier place: the first occurrence of a line is kept.

Only documents with a chunk that occurs again are joined with their chunks.  A bitmap of ``BITS`` bits, marked by the hashes
of these documents, meets the documents in their scan (8 MB broadcast, at any size of the corpus) and lets most others
go straight to the output; those it lets through by chance meet no chunk.  A text is split once for all
its chunks and rebuilt once from the numbers of the lines that stay, so the work follows its lines.

Defined cases: NULL and empty texts stay as they are; lines without words are
never removed; a text loses its lines only, what is kept stays in order, joined by
newlines; rows with equal id and text are one document and are treated alike
(a copy under another id is a repetition); NULL ids come first in the order;
other columns, whatever their names, are carried along; an empty table gives no
rows.  No row, line or chunk is capped; nothing is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsgauge.llm.common import WORD
from obsgauge.sources.shared import written

DIVISOR = 4
LEAST_WORDS = 20
PASSAGE_WORDS = 50
#: Bits of the filter for documents with repeated chunks: 2048 pieces of 4 KB.
BITS = 1 << 26
BITS_A_PIECE = 32768


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, no, h, words, before): one narrow row a line with a word; ``before``: words above it.

    Lines leave their text right after the split; equal rows (same id and text) fall together per line.
    """
    lines = docs.select(F.col(id_col).alias("id"), _text_hash(F.col(text_col)).alias("th"),
                        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("no", "line"))
    rows = (lines.select("id", "th", "no", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).alias("words"))
            .where("words > 0").repartition("id", "th").groupBy("id", "th", "no").agg(F.max("h").alias("h"), F.max("words").alias("words")))
    above = Window.partitionBy("id", "th").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("words").over(above), F.lit(0)).cast("long"))


def chunks(docs: DataFrame, id_col: str, text_col: str, divisor: int, least_words: int, passage_words: int) -> DataFrame:
    """(id, th, first, last, k1, k2): the chunks of both kinds with their line numbers and hashes."""
    lines = _lines(docs, id_col, text_col)
    doc = Window.partitionBy("id", "th")
    reach = doc.orderBy("before").rangeBetween(0, passage_words - 1)
    anchored = (lines.withColumn("hashes", F.collect_list("h").over(reach)).withColumn("n", F.sum("words").over(reach))
                .withColumn("last", F.max("no").over(reach)).where(F.col("n") >= passage_words)
                .select("id", "th", F.col("no").alias("first"), "last", "hashes"))
    back = doc.orderBy("through").rangeBetween(1 - passage_words, 0)
    mirrored = (lines.withColumn("through", F.col("before") + F.col("words"))
                .withColumn("hashes", F.collect_list("h").over(back)).withColumn("n", F.sum("words").over(back))
                .withColumn("first", F.min("no").over(back))
                .where((F.col("n") >= passage_words) & (F.col("n") - F.col("words") >= passage_words))  # else it is the run from its first line
                .select("id", "th", "first", F.col("no").alias("last"), "hashes"))
    rolling = F.xxhash64("h", F.lag("h").over(doc.orderBy("no")))
    cut = lines.withColumn("ends", (F.pmod(rolling, F.lit(divisor)) == 0).cast("int"))
    cut = cut.withColumn("chunk", F.coalesce(F.sum("ends").over(doc.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    defined = (cut.groupBy("id", "th", "chunk").agg(
        F.min("no").alias("first"), F.max("no").alias("last"), F.sum("words").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("no", "h"))), lambda s: s["h"]).alias("hashes"))
        .where((F.size("hashes") > 1) & (F.col("n") >= least_words)).select("id", "th", "first", "last", "hashes"))
    return anchored.unionByName(mirrored).unionByName(defined).select(
        "id", "th", "first", "last", F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(1), F.size("hashes"), "hashes").alias("k2"))


def _marked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (__id, __th, ...) with ``__hit``: false only where no row of ``found`` (id, th) is of that document."""
    place = lambda i, th: F.pmod(F.xxhash64(i, th), F.lit(BITS))
    at = found.select(place(F.col("id"), F.col("th")).alias("at"))
    pieces = at.groupBy(F.expr(f"at div {BITS_A_PIECE}").alias("__piece")).agg(F.bitmap_construct_agg(F.expr(f"at % {BITS_A_PIECE}")).alias("__bits"))
    rows = rows.withColumn("__at", place(F.col("__id"), F.col("__th"))).withColumn("__piece", F.expr(f"__at div {BITS_A_PIECE}"))
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast(__at % {BITS_A_PIECE} div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.call_function("shiftright", byte, (F.col("__at") % 8).cast("int")).bitwiseAND(1) == 1
    joined = rows.join(F.broadcast(pieces), "__piece", "left")
    return joined.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__at", "__piece", "__bits")


def _with_lines(text: Column, use) -> Column:
    """``use(lines)`` with the text split once, however often ``use`` looks at its lines."""
    return F.transform(F.array(F.split(text, "\n", -1)), use)[0]


def _chunk_texts(text: Column, runs: Column) -> Column:
    """The runs with ``chunk``: their lines with words, joined; what two equal chunks share byte by byte."""

    def cut(lines: Column, r: Column) -> Column:
        taken = F.filter(F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1), lambda x: x.rlike(WORD))
        return F.struct(*[r[c].alias(c) for c in ("first", "last", "k1", "k2", "at")], F.array_join(taken, "\n").alias("chunk"))

    return _with_lines(text, lambda lines: F.transform(runs, lambda r: cut(lines, r)))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR,
                  least_words: int = LEAST_WORDS, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """(__row, __removed): every row of ``docs`` as a struct, and the runs (first, last) of line numbers that a later occurrence covers; NULL if none."""
    found = written(chunks(docs, id_col, text_col, divisor, least_words, passage_words), "chunks")
    at = F.struct(F.col("id"), F.col("th"), F.col("first"), F.col("last"))
    firsts = found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(at).alias("at")).where("n > 1").select("k1", "k2", "at")
    again = written(found.join(firsts, ["k1", "k2"]), "repeated-chunks")
    runs = again.groupBy("id", "th").agg(F.collect_list(F.struct("first", "last", "k1", "k2", "at")).alias("runs"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"),
                       _text_hash(F.col(text_col)).alias("__th"))
    rows = _marked(rows, again)
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th"))
    with_runs = written(rows.where("__hit").join(runs, same, "left").select("__row", "__id", "__th", "runs"), "documents-with-chunks")

    # Byte comparison: of each chunk that occurs again with the text at its first occurrence.
    text = F.col("__row").getField(text_col)
    each = (with_runs.where("runs is not null").select("__id", "__th", F.inline(_chunk_texts(text, F.col("runs")))))
    # Equal texts of a chunk fall together on the map side, so a passage in every document is a few rows here.
    texts = each.groupBy("k1", "k2", "chunk").agg(F.lit(1).alias("one")).groupBy("k1", "k2").agg(F.count("*").alias("n"))
    unequal = written(texts.where("n > 1").select("k1", "k2"), "unequal-chunks")

    later = F.expr("""
        transform(filter(runs, r -> not (r.at.id <=> __id and r.at.th = __th and r.at.first = r.first and r.at.last = r.last)),
                  r -> struct(r.first as first, r.last as last))""")
    if not unequal.isEmpty():  # two texts with one pair of hashes: only what equals the first occurrence goes
        doubtful = each.join(unequal, ["k1", "k2"])
        is_first = F.expr("at.id <=> __id and at.th = __th and at.first = first and at.last = last")
        originals = doubtful.where(is_first).groupBy("k1", "k2").agg(F.first("chunk").alias("original"))
        spared = (doubtful.where(~is_first).join(originals, ["k1", "k2"]).where(F.col("chunk") != F.col("original"))
                  .groupBy(F.col("__id").alias("i"), F.col("__th").alias("t")).agg(F.collect_set(F.struct("first", "last", "k1", "k2")).alias("spared")))
        runs_left = F.expr("filter(runs, r -> not array_contains(spared, struct(r.first as first, r.last as last, r.k1 as k1, r.k2 as k2)))")
        with_runs = (with_runs.join(spared, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t")), "left")
                     .withColumn("runs", F.when(F.col("spared").isNull(), F.col("runs")).otherwise(runs_left)))
    touched = with_runs.select("__row", later.alias("__removed"))
    kind = touched.schema["__removed"].dataType
    return touched.unionByName(rows.where("not __hit").select("__row", F.lit(None).cast(kind).alias("__removed")))


def _kept_lines(text: Column, runs: Column) -> Column:
    """(kept, n): the text without the lines with words that the runs cover, and how many these are."""

    def left(lines: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["first"], r["last"]))))
        gone = F.filter(covered, lambda k: F.element_at(lines, k + 1).rlike(WORD))
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.struct(F.array_join(F.transform(stay, lambda k: F.element_at(lines, k + 1)), "\n").alias("kept"), F.size(gone).alias("n"))

    return _with_lines(text, left)


def _shortened(docs: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(__row, __kept, __n): every row with the text that is left and the number of lines taken out."""
    marked = removed_lines(docs, id_col, text_col, **how)
    text = F.col("__row").getField(text_col)
    out = F.when(F.size("__removed") > 0, _kept_lines(text, F.col("__removed")))
    rows = marked.select("__row", text.alias("__text"), out.alias("__out"))
    return rows.select("__row", F.when(F.col("__out").isNull(), F.col("__text")).otherwise(F.col("__out.kept")).alias("__kept"),
                       F.coalesce("__out.n", F.lit(0)).cast("long").alias("__n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_as: str = "__n_removed", **how) -> DataFrame:
    """(input columns with the text shortened, and ``count_as``, a name that the input does not use): lines of later occurrences taken out."""
    if count_as in docs.columns:
        raise ValueError(f"the input has a column {count_as}: name another in count_as")
    short = _shortened(docs, id_col, text_col, **how)
    return short.select(*[(F.col("__kept") if c == text_col else F.col("__row").getField(c)).alias(c) for c in docs.columns], F.col("__n").alias(count_as))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with shortened texts; the length column, if there is one, follows the text."""
    short = _shortened(docs, id_col, text_col)

    def column(name: str) -> Column:
        old = F.col("__row").getField(name)
        if name == text_col:
            return F.col("__kept")
        if name == length_col:
            return F.when(F.col("__n") > 0, F.char_length("__kept").cast(docs.schema[name].dataType)).otherwise(old)
        return old

    return short.select(*[column(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, how many lines went and the text that is left."""
    short = _shortened(docs, "doc_id", "text")
    return short.select(F.col("__row.doc_id").alias("doc_id"), F.col("__n").alias("n_removed"), F.col("__kept").alias("kept_text"))
