import hashlib
import random
import zlib

import numpy as np

from obsgauge.llm import hilbert, lempel_ziv, url_cascade


def plain_judge(url, rules, domains):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = rest[:cut].translate(str.maketrans(url_cascade.UPPER, url_cascade.LOWER))
    path = rest[cut:] if rest[cut:cut + 1] == "/" else ""
    path = path.split("?")[0].split("#")[0]
    fits = []
    for rule, kind in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), kind == "block", rule))
    if fits:
        best = max(fits)
        return host, path, best[2], "block" if best[1] else "allow"
    return host, path, None, "block" if any(host == d or host.endswith("." + d) for d in domains) else "allow"


def test_verdicts_against_plain_rules(spark):
    draw = random.Random(6)
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("a.b.org/fr/x", "block")]
    names = [f"s{k}.example.{e}" for k in range(60) for e in ("com", "net", "org")] + ["net", "NET", "a.b.org", "x.a.b.org", "xnet", "com", ""]
    paths = ["", "/", "/en/", "/en", "/de/1?x=/de/", "/fr/x#y", "/fr/xy", "?q=://", "#://a/", "/EN/", "//"]
    urls = [f"http://{draw.choice(['', 'WWW.', 'm.'])}{n}{p}" for n in names for p in draw.sample(paths, 4)]
    urls += [None, "", "nothing", "://", "a://b://c/d", "http://Ünet.net/\n/en/"]
    domains = [f"s{k}.example.com" for k in range(0, 60, 3)] + ["unseen.example", "s4.example.org", "Com2.x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    listed = spark.createDataFrame([(d,) for d in domains], "domain string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(
        pages, [r for r, k in rules if k == "block"], [r for r, k in rules if k == "allow"], listed).collect()}
    for key, url in enumerate(urls):
        assert got[key] == plain_judge(url, rules, domains), url


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) key")
    for step in (2, 50, 7000):
        listed = spark.range(0, 20_000, step).selectExpr("concat('k', id) key")
        cascade = url_cascade.Cascade(universe, listed)
        found = {r.key for r in universe.where(cascade.contains(universe.key)).collect()}
        assert found == {r.key for r in listed.collect()}
    assert universe.where(url_cascade.Cascade(universe, listed.limit(0)).contains(universe.key)).count() == 0


def test_urls_empty_lists_and_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (None, None), (1, "http://a.net/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "domain string")
    assert [r.verdict for r in url_cascade.judge(pages, [], [], none).collect()] == ["allow"] * 3
    assert url_cascade.judge(pages.limit(0), ["net/"], [], none).count() == 0


def test_curve_visits_every_cell_through_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        index = hilbert.hilbert_index(list(cells.T), bits)
        assert sorted(index) == list(range(side ** n))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(docs_of, awkward, nothing):
    draw = random.Random(3)
    docs = docs_of([(k, "x" * draw.choice([0, 1, 10, 900]), "hot" if k % 3 else f"s{k % 7}") for k in range(1001)], partitions=5)
    rows = hilbert.digest(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
    assert len(rows) == 1001 and set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    spread = {}
    for r in rows:
        spread.setdefault(r.shard, set()).add(r.size)
    assert sum(map(len, spread.values())) < 24 * 2.5  # four sizes there are; a shard holds few of them
    assert sorted(map(str, rows)) == sorted(map(str, hilbert.digest(docs.repartition(2)).collect()))
    assert hilbert.digest(awkward).count() == awkward.count() and hilbert.digest(nothing).count() == 0


def test_neighbours_by_definition(docs_of, nothing):
    draw = random.Random(2)
    rows = [(k * 3, "".join(draw.choices(["the ", "cat ", "réad ", "\U0001f600", "dog\n"], k=draw.choice([0, 1, 5, 400])))) for k in range(150)]
    rows[7] = (rows[7][0], None)
    rows[9] = (rows[9][0], rows[8][1])
    got = {r.doc_id: r for r in lempel_ziv.neighbours(docs_of(rows, partitions=6)).collect()}
    signer = lempel_ziv.Signer()
    assert len(got) == len(rows)
    for k, (key, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        change = text[:len(text) - half] + following[:half]
        a, b, c = signer.of(text), signer.of(change), signer.of(following)
        assert got[key] == (key, len(text), hashlib.sha256(change.encode()).hexdigest(), lempel_ziv.as_text(a),
                            lempel_ziv.as_text(b), lempel_ziv.likeness(a, b), lempel_ziv.likeness(a, c))
    assert got[rows[8][0]].fingerprint == got[rows[9][0]].fingerprint and got[rows[8][0]].near_next == 1.0
    assert lempel_ziv.neighbours(nothing).count() == 0
    alone = lempel_ziv.neighbours(docs_of([(5, "all alone here")])).collect()
    assert alone[0].near_next == 1.0 and alone[0].n_chars == 14


def test_neighbours_awkward(awkward):
    rows = lempel_ziv.neighbours(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {"f" * 256}
    far = [r for r in rows if r.doc_id == 5][0]
    assert far.n_chars > 100_000
    again = [r.fingerprint for r in rows if r.doc_id == 4]
    assert len(set(again)) == 1


def test_signature_estimates_common_phrases():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300)]
    text = " ".join(draw.choices(words, k=2000))
    other = " ".join(draw.choices(["".join(draw.choices("ijklmnop", k=6)) for _ in range(300)], k=2000))
    signer = lempel_ziv.Signer()
    half = lempel_ziv.edited(text, other)
    a, b, c = (lempel_ziv.Phrases().read(t).found for t in (text, half, other))
    for x, y in ((a, b), (a, c)):
        x, y = ({p for p in s if len(p) >= lempel_ziv.SHORTEST} for s in (x, y))
        share = len(x & y) / len(x | y)
        signed = [lempel_ziv.Phrases(set(s)) for s in (x, y)]
        assert abs(lempel_ziv.likeness(*map(signer.signature, signed)) - share) < 0.2


def test_signature_rests_on_all_phrases():
    """A phrase of four characters does not push the shorter ones out."""
    draw = random.Random(2)
    short = ["".join(draw.choices("abcdefgh", k=3)) for _ in range(200)]
    signer = lempel_ziv.Signer()
    for x, y in (({*short[:60], "same"}, {*short[60:120], "same"}), ({*short[:80], "left"}, {*short[:80], "rest"})):
        share = len(x & y) / len(x | y)
        signed = [lempel_ziv.Phrases(set(s)) for s in (x, y)]
        assert abs(lempel_ziv.likeness(*map(signer.signature, signed)) - share) < 0.2
    text = "the cat sat on the mat and the dog sat on the log"
    assert 0 < lempel_ziv.likeness(signer.of(text), signer.of(text + " at last")) < 1
