import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from obsgauge.llm import golay, line_chunks

WORDS = [f"w{k}" for k in range(4000)]


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, near):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    order = sorted(values)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if near(a, b):
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_golay_decodes_and_shares_keys():
    code, draw = golay.Golay(), random.Random(3)
    assert len({int(golay._rest(e)) for e in [0, *code.error.tolist()]}) == 2048  # perfect: every syndrome once
    for _ in range(500):
        v = draw.getrandbits(23)
        w = v
        for b in draw.sample(range(23), draw.randint(0, 2)):
            w ^= 1 << b
        a, b = (set(code.keys(np.array([x]))[0].tolist()) for x in (v, w))
        assert a & b and len(a) <= 6


@pytest.mark.parametrize("crowd", [1, 3, golay.CROWD, 1 << 30])
def test_links_equal_all_pairs(spark, monkeypatch, crowd):
    """By half-way words alone, by both ways, and by joined Golay keys alone."""
    monkeypatch.setattr(golay, "CROWD", crowd)
    draw = random.Random(5)
    fps = {0, -1, 1 << 63}
    for _ in range(40):
        centre = draw.getrandbits(64)
        fps.add(centre)
        for _ in range(draw.choice([1, 5, 40])):
            x = centre
            for b in draw.sample(range(64), draw.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
            centre = x if draw.random() < 0.3 else centre
    signed = {(f & (1 << 64) - 1) - (1 << 64 if (f & (1 << 64) - 1) >> 63 else 0) for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    got = {r.fp: r.label for r in golay.grouped(frame).collect()}
    want = classes(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    smallest = {}
    for f, c in want.items():
        smallest[c] = min(smallest.get(c, f), f)
    assert got == {f: smallest[c] for f, c in want.items()}


def test_near_duplicates_against_brute_force(docs_of):
    draw = random.Random(9)
    rows, texts = [], []
    for _ in range(40):
        texts.append(" ".join(draw.choices(WORDS, k=draw.choice([0, 1, 2, 5, 300]))))
    for k in range(160):
        words = draw.choice(texts).split(" ")
        if len(words) > 20 and draw.random() < 0.6:
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        rows.append((draw.choice([None, *range(3000)]) if k % 9 == 0 else k * 10, " ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in golay.digest(docs_of(rows)).collect()), key=str)
    fps = [plain_simhash(t) for _, t in rows]
    group = classes(set(fps), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (key, _), f in zip(rows, fps, strict=True):
        if key is not None:
            least[group[f]] = min(least.get(group[f], key), key)
    want = sorted(((key, f"{f:016x}", least.get(group[f])) for (key, _), f in zip(rows, fps, strict=True)), key=str)
    assert got == want


def test_awkward_rows(awkward, nothing):
    rows = golay.digest(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    awkward = awkward.withColumns({c: F.lit(c) for c in ("__k1", "k1", "k2", "best")})
    kept = golay.one_of_each(awkward)
    assert kept.where("`__k1` <> '__k1' or k1 <> 'k1' or k2 <> 'k2'").count() == 0
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(4) == 0 and ids.count(1) == 1 and ids.count(2) == 1
    assert golay.digest(nothing).count() == 0 and golay.one_of_each(nothing).count() == 0


def plain_line_dedup(rows, passage=50, divisor=4, least_words=20):
    """Lines of later occurrences, from all pairs of places: blocks of whole lines with ``passage`` words, and content-defined chunks."""
    import struct

    import xxhash

    def rolled(before, line):
        as_bytes = lambda h: struct.pack("<Q", h)
        own = xxhash.xxh64_intdigest(line.encode(), 42)
        h = xxhash.xxh64_intdigest(as_bytes(own), 42)
        return h if before is None else xxhash.xxh64_intdigest(as_bytes(xxhash.xxh64_intdigest(before.encode(), 42)), h)

    docs = [[(key, k, x) for k, x in enumerate(text.split("\n")) if x.split()] for key, text in sorted(rows)]
    gone, seen = set(), set()
    for d, lines in enumerate(docs):
        for e, other in enumerate(docs[:d + 1]):
            for i in range(len(lines)):
                for j in range(len(other) if e < d else i):
                    n = size = 0
                    while i + n < len(lines) and j + n < len(other) and lines[i + n][2] == other[j + n][2]:
                        size += len(lines[i + n][2].split())
                        n += 1
                    if size >= passage:
                        gone.update((key, k) for key, k, _ in lines[i:i + n])
        chunk = []
        for at, line in enumerate(lines):
            chunk.append(line)
            signed = rolled(lines[at - 1][2] if at else None, line[2])
            if signed % divisor == 0 or at == len(lines) - 1:
                text = tuple(x for _, _, x in chunk)
                if len(chunk) > 1 and sum(len(x.split()) for x in text) >= least_words:
                    if text in seen:
                        gone.update((key, k) for key, k, _ in chunk)
                    seen.add(text)
                chunk = []
    return {key: "\n".join(x for k, x in enumerate(text.split("\n")) if (key, k) not in gone) for key, text in rows}


def test_passages_go_and_clean_text_stays(docs_of):
    draw = random.Random(12)

    def line(n):
        return " ".join(draw.choices(WORDS, k=n))

    passages = [[line(60)], [line(20), line(15), line(30)], [line(7) for _ in range(9)], [line(30), "", line(30)]]
    rows = []
    for key in range(60):
        lines = [line(draw.randint(3, 25)) for _ in range(draw.randint(1, 12))] + ["All rights reserved."]
        for p in draw.sample(passages, draw.randint(0, 2)):
            at = draw.randint(0, len(lines))
            lines[at:at] = p
        rows.append((key, "\n".join(lines)))
    got = {r.doc_id: r.kept_text for r in line_chunks.digest(docs_of(rows)).collect()}
    assert got == plain_line_dedup(rows)
    assert sum(got[k].count(passages[0][0]) for k in got) == 1
    assert {x for t in got.values() for x in t.split("\n")} == {x for _, t in rows for x in t.split("\n")}


def plain_blocks(rows, passage=50):
    """Lines of every later occurrence of a repeated block of whole lines with at least ``passage`` words: all pairs of places."""
    lines = [[(key, k, x) for k, x in enumerate(text.split("\n")) if x.split()] for key, text in sorted(rows)]
    gone = set()
    for d, later in enumerate(lines):
        for earlier in lines[:d]:
            for i in range(len(later)):
                for j in range(len(earlier)):
                    n = size = 0
                    while i + n < len(later) and j + n < len(earlier) and later[i + n][2] == earlier[j + n][2]:
                        size += len(later[i + n][2].split())
                        n += 1
                    if size >= passage:
                        gone.update((key, k) for key, k, _ in later[i:i + n])
    return {key: "\n".join(x for k, x in enumerate(text.split("\n")) if (key, k) not in gone) for key, text in rows}


def test_last_lines_of_a_passage_go_too(docs_of):
    """Repeated blocks go whole, also the lines from which no run of passage length starts inside the block."""
    draw = random.Random(31)
    fresh = iter(range(1_000_000))

    def line(n):
        return " ".join(f"v{next(fresh)}" for _ in range(n))

    blocks = [[line(n) for n in sizes] for sizes in ((59, 18), (25, 25, 3, 4), (50, 1), (10, 45, 20, 20), (49,), (20, 29), (7,) * 9)]
    rows = []
    for key in range(24):
        lines = []
        for block in draw.sample(blocks, 2):
            lines += [line(draw.randint(3, 25)), *block]
        rows.append((key, "\n".join([*lines, line(9)])))
    got = {r.doc_id: r.text for r in line_chunks.dedup_lines(docs_of(rows), divisor=1 << 30).collect()}
    assert got == plain_blocks(rows)


def test_content_defined_chunks_find_short_repeats(docs_of):
    """Two or more lines between two cuts, under the passage length, are found whatever stands above."""
    draw = random.Random(1)
    block = "\n".join(" ".join(draw.choices(WORDS, k=12)) for _ in range(40))
    rows = [(k, "\n".join(f"own {k} {j}" for j in range(k)) + "\n" + block) for k in range(1, 5)]
    out = {r.doc_id: r for r in line_chunks.dedup_lines(docs_of(rows), passage_words=10_000).collect()}
    assert out[1]["__n_removed"] == 0
    for k in (2, 3, 4):
        assert out[k]["__n_removed"] >= 15 and f"own {k} 0" in out[k].text


def test_colliding_hashes_are_told_apart(docs_of, monkeypatch):
    """With one hash for all chunks, only those that equal the first occurrence byte by byte go."""
    plain = line_chunks.chunks
    monkeypatch.setattr(line_chunks, "chunks", lambda *a: plain(*a).withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long")}))
    rows = [(1, "a " * 60), (2, "b " * 60), (3, "a " * 60), (4, "b " * 60)]
    got = {r.doc_id: r.n_removed for r in line_chunks.digest(docs_of(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_line_dedup_awkward(awkward, nothing, docs_of):
    out = line_chunks.cleaned(awkward)
    assert out.columns == awkward.columns and out.count() == awkward.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] is None and texts[3] == "" and texts[6] == " \n\t "
    assert len(texts[8].split("\n")) == 1  # all but its changed last line is in document 5
    assert line_chunks.cleaned(nothing).count() == 0
    same = line_chunks.digest(docs_of([(1, "x " * 60), (1, "x " * 60), (2, "x " * 60)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in same) == [(1, 0), (1, 0), (2, 1)]


def test_long_texts_take_time_as_their_lines(docs_of):
    """Two texts of 30,000 lines that differ in every tenth line; in between every line is covered by many runs."""
    import time

    lines = [f"line {k} of a long text that another text repeats" for k in range(30_000)]
    other = [f"{x} but here" if k % 10 == 0 else x for k, x in enumerate(lines)]
    start = time.time()
    got = {r.doc_id: r for r in line_chunks.digest(docs_of([(1, "\n".join(lines)), (2, "\n".join(other))])).collect()}
    assert time.time() - start < 60
    assert got[1].n_removed == 0 and got[1].kept_text.count("\n") == 29_999
    assert got[2].n_removed == 27_000 and got[2].kept_text.count("but here") == 3_000


def test_columns_named_like_the_inner_ones_are_carried_along(docs_of):
    from pyspark.sql import functions as F

    text = "\n".join(f"some line of many words number {k}" for k in range(20))
    docs = docs_of([(1, text), (2, text)]).withColumns({n: F.lit(n) for n in ("__n_removed", "__kept", "__n", "__hit", "runs", "__id", "__bits")})
    out = line_chunks.cleaned(docs)
    assert out.columns == docs.columns
    assert {(r["__n_removed"], r["__hit"], r["runs"]) for r in out.collect()} == {("__n_removed", "__hit", "runs")}
