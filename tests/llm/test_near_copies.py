import random

from pyspark.sql import functions as F

from obsgauge.llm import golay, lsh_forest, near_copies

WORDS = [f"w{k}" for k in range(4000)]


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(rows, least=0.8):
    """Smallest id of every component of all pairs."""
    sets = {key: plain_shingles(text) for key, text in rows}
    parent = {key: key for key in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {find(k) for k in sets}


def edited(draw, words, n):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = draw.choice(WORDS)
    return words


def test_a_few_edited_words_are_near_copies(docs_of):
    """Pairs at Jaccard >= 0.8 whose fingerprints are more than 2 bits apart go, pairs below stay."""
    draw = random.Random(21)
    simhash = golay.fingerprint_of()
    rows, far = [], 0
    for k in range(60):
        base = draw.choices(WORDS, k=draw.choice([60, 120, 300]))
        copy = edited(draw, base, draw.choice([1, 1, 2, 3, 6]))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy).upper())]
        a, b = (plain_shingles(t) for _, t in rows[-2:])
        bits = ((simhash(rows[-2][1]) ^ simhash(rows[-1][1])) & (1 << 64) - 1).bit_count()
        far += len(a & b) >= 0.8 * len(a | b) and bits > 2
    assert far >= 10
    want = plain_kept(rows)
    assert 60 < len(want) < 120
    assert {r.doc_id for r in near_copies.one_of_each(docs_of(rows)).collect()} == want


def test_chains_groups_and_short_texts(docs_of):
    """Chains link through their middle; a group is compared beyond the smallest node of its keys."""
    draw = random.Random(8)
    rows = [(k, t) for k, t in enumerate(["", None, " \n", "a b c", "A  b c", "a b c d", "a b c d e"])]
    words = draw.choices(WORDS, k=200)
    for k in range(120):
        words = edited(draw, words, 2)
        rows.append((100 + k, " ".join(words)))
    for k in range(80):
        words = edited(draw, rows[50][1].split(), draw.choice([3, 8]))
        rows.append((400 + k, " ".join(words)))
    got = [r.doc_id for r in near_copies.one_of_each(docs_of(rows)).collect()]
    assert sorted(got) == sorted(plain_kept(rows))


def test_a_key_of_many_different_texts_gives_few_pairs(docs_of, monkeypatch):
    """Texts alike in half of their shingles share keys; pairs grow as the texts, and near copies among them are found."""
    draw = random.Random(4)
    frame = draw.choices(WORDS, k=150)
    rows = [(k, " ".join(frame + draw.choices(WORDS, k=50))) for k in range(1500)]
    rows += [(10_000 + k, rows[k][1] + " end") for k in range(0, 1500, 50)]
    pairs = []
    confirmed = lsh_forest.confirmed
    monkeypatch.setattr(lsh_forest, "confirmed", lambda some, sets: pairs.append(some.count()) or confirmed(some, sets))
    kept = {r.doc_id for r in near_copies.one_of_each(docs_of(rows)).collect()}
    assert kept == set(range(1500))
    assert max(pairs) <= lsh_forest.TREES * len(rows) and pairs[-1] < len(rows)


def test_near_copies_awkward(awkward, nothing):
    awkward = awkward.withColumns({c: F.lit(c) for c in ("__k1", "k1", "k2", "node", "name", "best")})
    kept = near_copies.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 0 and ids.count(1) == 1 and ids.count(2) == 1 and ids.count(8) == 0
    assert near_copies.one_of_each(nothing).count() == 0


def test_fingerprints_give_the_first_candidates(spark):
    """All fingerprints within two bits are connected before any signature order is looked at."""
    base = 0x0F0F_1234_5678_9ABC
    fps = [(0, base), (1, base), (2, base ^ 1), (3, base ^ 3), (4, base ^ 0b111 << 40), (5, ~base)]
    pairs = {tuple(r) for r in near_copies.by_fingerprint(spark.createDataFrame(fps, "node bigint, fp bigint")).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 3), (2, 3)}
