import random

from pyspark.sql import functions as F

from obsgauge.llm import lsh_forest as forest


def plain_set(text):
    words = (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def plain(rows):
    """Sorted (doc_id, n_shingles, component, kept) from all pairs; ids are unique."""
    sets = {k: plain_set(t) for k, t in rows}
    label = {k: k for k in sets}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(sets)
    for x, a in enumerate(keys):
        for b in keys[x + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((top(a), top(b)))
                label[high] = low
    return sorted((k, len(sets[k]), top(k), k == top(k)) for k in keys)


def got(docs):
    return sorted(tuple(r) for r in forest.digest(docs).collect())


def corpus(draw):
    """Copies, near copies on both sides of the border, a large group of near copies, a template with many different fillings."""
    words = [f"w{k}" for k in range(3000)]
    texts = [draw.choices(words, k=draw.randint(1, 80)) for _ in range(120)]
    for k in range(120):
        base = list(texts[draw.randrange(len(texts))])
        for _ in range(draw.randint(0, max(1, len(base) // 12))):
            base[draw.randrange(len(base))] = draw.choice(words)
        texts.append(base)
    large = draw.choices(words, k=120)
    for k in range(300):
        copy = list(large)
        copy[draw.randrange(120)] = f"own{k}"
        texts.append(copy)
    frame = draw.choices(words, k=60)
    for k in range(150):
        texts.append(frame + draw.choices(words, k=draw.randint(10, 40)))
    texts += [[], ["one"], ["ONE"], ["two"], texts[0], [w.upper() for w in texts[0]]]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def test_all_pairs_by_definition(docs_of):
    rows = corpus(random.Random(8))
    want = plain(rows)
    assert got(docs_of(rows)) == want
    assert sum(not r[3] for r in want) > 350 and sum(r[3] for r in want) > 150


def test_regions_get_deeper_where_documents_crowd(spark, docs_of):
    rows = forest.row_keys(docs_of(corpus(random.Random(9))), "doc_id", "text")
    nodes = forest.signed(rows).where("name is not null").dropDuplicates(["name"]).withColumn("node", F.xxhash64("name")).cache()
    members = forest.regions(nodes.select("node", "n", "paths")).cache()
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("tree").alias("trees"))
    least, most, trees = sizes.agg(F.min("n"), F.max("n"), F.max("trees")).first()
    assert trees == 1 and most <= 2 * forest.CROWD  # a hash divides what is crowded at full depth, nearly evenly
    first = forest.neighbours(forest._labelled(members.where("tree = 0"), None)).count()
    assert first < nodes.count()


def test_links_that_crowded_regions_part(docs_of):
    """Texts alike in 0.78 of their shingles crowd every region at full depth; the pairs of them just above 0.8 are all found."""
    frame = [f"w{k}" for k in range(176)]
    texts = [frame + [f"own{k}x{x}" for x in range(24)] for k in range(1200)]
    for k in range(0, 80, 2):
        texts[k + 1][176:180] = texts[k][176:180]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    one, other, third = (plain_set(rows[k][1]) for k in (0, 1, 2))
    assert 80 <= 100 * len(one & other) / len(one | other) < 82 and 77 < 100 * len(one & third) / len(one | third) < 79
    assert [r[2] for r in got(docs_of(rows))] == [k - 1 if k < 80 and k % 2 else k for k in range(1200)]


def test_awkward_rows(awkward, nothing):
    rows = sorted((tuple(r) for r in forest.digest(awkward).collect()), key=repr)
    by_id = [(r[0], r[2], r[3]) for r in rows if r[0] is not None]
    assert by_id == [(1, 1, True), (2, 2, True), (3, 3, True), (4, 1, False), (4, 1, False), (5, 5, True), (6, 6, True), (7, 7, True), (8, 5, False), (9, 9, True)]
    assert [r[2:] for r in rows if r[0] is None] == [(None, True)] * 2
    assert len(rows) == awkward.count()
    assert forest.digest(nothing).count() == 0


def test_a_crowded_shingle_costs_copies_of_the_few_and_loses_no_pair(spark, monkeypatch):
    """400 near copies in one component and 60 texts about 0.8 from them, all with the same rarest shingles."""
    monkeypatch.setattr(forest, "PIECE", 16)
    draw = random.Random(3)
    base = [draw.getrandbits(64) for _ in range(150)]
    own = lambda k: set(draw.sample(base, 150 - k)) | {draw.getrandbits(64) for _ in range(k)}
    found = [(k, 0, own(2)) for k in range(400)] + [(k, k, own(10 + k % 20)) for k in range(400, 460)]
    as_bytes = [(k, label, b"".join(x.to_bytes(8, "little") for x in sorted(s))) for k, label, s in found]
    rows = spark.createDataFrame(as_bytes, "node bigint, label bigint, hashes binary").cache()
    apart, sets = rows.select("node", "label"), rows.select("node", "hashes")
    alike = {(a, b) for a, la, x in found for b, lb, y in found if a < b and la != lb and 100 * len(x & y) >= 80 * len(x | y)}
    got = {tuple(r) for r in forest.sharing_rare(apart, sets).collect()}
    assert alike <= got and len(got) <= 1.5 * len(alike) and len(alike) > 1000
    listed = forest.rarest(rows)
    shared = listed.join(forest.rare_regions(listed), "shingle").cache()
    one, other = forest.dealt(shared)
    crowd, copies = shared.agg(F.max("crowd")).first()[0], other.count()
    assert crowd > 200 and one.count() == shared.count()
    cross = sum(r.crowd * r.few for r in shared.groupBy("shingle").agg(F.max("crowd").alias("crowd"), F.count_if(F.col("label") != F.col("main")).alias("few")).collect())
    assert copies <= cross / forest.PIECE + shared.count()


def test_a_frame_that_leads_no_set_is_not_joined(spark):
    """Sets of 24 own shingles and a frame of 175 list some of the frame, but none has it in its first ninth."""
    draw = random.Random(4)
    frame = [draw.getrandbits(63) for _ in range(175)]
    rows = [(k, k, b"".join(x.to_bytes(8, "little") for x in sorted(frame + [draw.getrandbits(63) for _ in range(24)]))) for k in range(300)]
    listed = forest.rarest(spark.createDataFrame(rows, "node bigint, label bigint, hashes binary")).cache()
    assert listed.groupBy("shingle").count().agg(F.max("count")).first()[0] == 300
    assert forest.rare_regions(listed).isEmpty()


def test_sketches_differ_in_no_more_bits_than_the_sets(spark):
    draw = random.Random(5)
    pool = [draw.getrandbits(64) for _ in range(4000)]
    sets = [set(draw.sample(pool, draw.choice((1, 5, 150, 3000)))) for _ in range(40)]
    rows = [(k, b"".join(x.to_bytes(8, "little") for x in sorted(s))) for k, s in enumerate(sets)]
    got = {r[0]: [x & (1 << 64) - 1 for x in r[1:]] for r in forest.sketched(spark.createDataFrame(rows, "node bigint, hashes binary")).collect()}
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(got[a], got[b]))
    assert all(bits(a, b) <= len(sets[a] ^ sets[b]) for a in got for b in got)
    assert sum(x.bit_count() for x in got[next(k for k in got if len(sets[k]) == 1)]) == 1
