import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsgauge.llm import isolation, neighbour_vote, toxicity
from obsgauge.llm.common import held_out

FOLDER = "/root/testdata/sf0.1"
CLEAN = [f"{a}{b}{c}" for a in ("ta", "ru", "mi", "so") for b in ("ber", "lin", "kas", "tor") for c in ("e", "i", "on", "um")]


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))


def outcome(rows, labels, column):
    joined = rows.join(labels.select("doc_id", column), "doc_id").where("held_out")
    return {(r[column], r.predicted): r["count"] for r in joined.groupBy(column, "predicted").count().collect()}


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    got = outcome(neighbour_vote.digest(docs, labels), labels, "quality")
    assert got[0, 0] >= 0.97 * (got[0, 0] + got.get((0, 1), 0))
    assert got[1, 1] >= 0.99 * (got[1, 1] + got.get((1, 0), 0))


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    got = outcome(toxicity.digest(docs, labels), labels, "toxic")
    assert got[1, 1] >= 0.9 * (got[1, 1] + got.get((1, 0), 0))
    assert got[0, 0] >= 0.98 * (got[0, 0] + got.get((0, 1), 0))


def test_isolation_on_labelled_rows(tables):
    docs, labels = tables
    rows = isolation.digest(docs, labels).join(labels, "doc_id").where("not base_failed and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    got = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert got.get((0, True), 0) <= 0.05 * got[0, False] + 1
    assert got.get((1, False), 0) <= 0.01 * got[1, True]


def test_labels_of_the_held_out_fold_are_not_learned(spark, docs_of):
    rows = [(k, "awful" if zlib.crc32(str(k).encode()) % 5 == 0 else "fine") for k in range(400)]
    labels = spark.createDataFrame([(k, int(t == "awful")) for k, t in rows], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.digest(docs_of(rows), labels).collect()} == {0.0}
    marks = docs_of(rows).select(held_out(F.col("doc_id")).alias("h"), "text").distinct().collect()
    assert {(r.h, r.text) for r in marks} == {(True, "awful"), (False, "fine")}


def edits(word):
    letters = "abcxyz"
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + c + word[i + 1:] for c in letters)
        if i < len(word) - 1:
            yield word[:i] + word[i + 1] + word[i] + word[i + 2:]


def distance(a, b):
    """Edits with exchanges of neighbours."""
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_accepts_exactly_one_edit():
    entries = {"abcax": 1.0, "zebra": 1.0, "abc": 1.0, "yacht": 1.0}
    automaton, draw = toxicity.Automaton(entries), random.Random(1)
    words = {e for w in entries for e in edits(w)} | {"".join(draw.choices("abcxyzebrht", k=draw.randint(0, 7))) for _ in range(3000)}
    for word in words:
        starts = [w for w in entries if word.startswith(w)]
        close = [w for w in entries if len(w) >= 5 and distance(w, word) <= 1]
        got = automaton.match(word)
        if starts:
            assert got == (max(starts, key=len), False), word
        elif close:
            assert got is not None and got[1] and got[0] in close, word
        else:
            assert got is None, word


def toxic_corpus(draw):
    rows, labels = [], []
    for k in range(800):
        words = draw.choices(CLEAN, k=40)
        bad = k % 5 == 0
        if bad:
            for _ in range(2):
                words[draw.randrange(40)] = draw.choice(["grumble", "snark", "zilch"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_misspelled_and_quoted_terms(spark, docs_of):
    rows, labels = toxic_corpus(random.Random(8))
    docs = docs_of(rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert {"grumble", "snark", "zilch"} <= {e for e in model.entries} and len(model.entries) < 8
    score = toxicity.Scorer(model).score
    base = "taberon rulini mikasum sotore " * 8
    assert score(base) < 0.5 < score(base + "you grumble snark")
    assert score(base + "you grumbel and snrak") > 0.5
    assert score(base + 'they wrote "you grumble, snark" here') < score(base + "you grumble, snark here")
    assert score(None) == score("") == score(base) < 0.5


def test_scores_of_awkward_rows(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (3, 7, 7), (4, 1, 0), (4, 1, 0), (5, 0, 1), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, odd):
        for digest in (neighbour_vote.digest, toxicity.digest, isolation.digest):
            rows = digest(awkward, labels).collect()
            assert len(rows) == awkward.count()
            assert digest(nothing, labels).count() == 0
            if "score" in rows[0]:
                assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out in (True, False) for r in rows)
    kept = toxicity.rejected(awkward, toxicity.fit(awkward, odd))
    assert kept.columns == awkward.columns


def test_a_worker_holds_no_scorer_and_few_texts_after_a_stage(spark, docs_of, tmp_path):
    """Workers go on to other stages: what the toxicity stage remembers goes with its task, and later batches are short."""
    import corpus_pipeline

    docs_of([(k, "you are a nasty fool" if k % 2 else "a calm day") for k in range(400)], 8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(400).selectExpr("id doc_id", "cast(id % 2 as int) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.safe(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() <= 400

    def look(batches):
        import gc

        import pyarrow as pa

        gc.collect()
        held = sum(isinstance(x, toxicity.Scorer) for x in gc.get_objects())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([batch.num_rows])], names=["held", "rows"])

    seen = spark.range(0, 40_000, 1, 8).mapInArrow(look, "held bigint, rows bigint").collect()
    assert max(r.held for r in seen) == 0 and max(r.rows for r in seen) <= 1000



def test_base_statistics_by_definition():
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choices(["ab ", "c ", "# ", "x<y ", "\n", "ab c d ", "éè ", "\t"], k=draw.randint(0, 60)))
        words = text.encode().split()
        got = dict(zip(isolation.STATISTICS, isolation.measure(text)[0], strict=True))
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert got == {"n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text),
                       "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated)}


def test_forest_sets_odd_rows_apart():
    draw = np.random.default_rng(0)
    rows = np.vstack([draw.normal(0, 0.1, (500, 3)), [[5, 5, 5], [-4, 0, 3]]])
    anomaly = isolation.Forest(rows).anomaly(rows)
    assert anomaly[-2:].min() > np.quantile(anomaly[:500], 0.99)
    good = np.arange(502) < 500
    cut = isolation.best_threshold(anomaly, good)
    assert ((anomaly < cut) == good).all()


def test_vote_equals_plain_cosines():
    draw = np.random.default_rng(1)
    texts = [" ".join(draw.choice(CLEAN, 30)) if k % 2 else " ".join(w + "###" for w in draw.choice(CLEAN, 30)) for k in range(120)]
    rows = np.stack([neighbour_vote.terms(t) for t in texts])
    labels = (np.arange(120) % 2).astype("float32")
    model = neighbour_vote.Model(rows[:80], labels[:80])
    got = model.scores(rows[80:])
    for k in range(40):
        v = model._unit(model._weighted(rows[80 + k:81 + k]) @ model.projection)[0]
        cosines = np.array([float(v @ u) for u in model.vectors])
        near = np.argsort(-cosines)[:neighbour_vote.NEIGHBOURS]
        w = np.maximum(cosines[near], 0) ** 8 + 1e-9
        assert got[k] == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-3)
    assert ((got > 0.5) == (labels[80:] == 1)).all()


def test_threshold_and_quantiles_rest_on_every_labelled_row(spark):
    """More labelled rows than any sample: the cut is that of all of them, and a tree's draws reach all of them."""
    draw = np.random.default_rng(4)
    anomaly, good = np.round(draw.beta(2, 5, 20_000), 4), draw.random(20_000) < 0.7
    good[anomaly > 0.6] = False
    rows = spark.createDataFrame([(float(a), bool(g)) for a, g in zip(anomaly, good)], "anomaly double, good boolean")
    assert isolation.cut(rows) == isolation.best_threshold(anomaly, good)
    assert isolation.cut(rows.where("good")) == float("inf")
    numbers = spark.range(10_000).selectExpr("id as doc_id", "100L as n_words", "500L as word_chars", "0L as n_symbols", "0L as n_dup_lines", "0L as n_repeat_words",
                                             "transform(sequence(1, 8), k -> id * 1.0D * k) as x")
    model = isolation.fit(numbers, spark.range(10_000).selectExpr("id as doc_id", "cast(id < 9000 as int) as quality"))
    taught = [k for k in range(9000) if zlib.crc32(str(k).encode()) % 5]
    assert model.usual[0] == taught[int(0.999 * len(taught) + 0.5) - 1]
    assert len(model.forest.trees) == isolation.TREES
