import hashlib
import random

import public_tokenizers
import pytest

from obsgauge.llm import byte_bpe, mixture

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(VOCABULARY), special_tokens={})


def test_encoder_equals_rank_driven_encoding(tiktoken_encoding):
    encoder, decoder = byte_bpe.Encoder(VOCABULARY, public_tokenizers.PATTERN), byte_bpe.Decoder(VOCABULARY)
    draw = random.Random(4)
    pieces = [t.decode("utf8", "ignore") for t in byte_bpe.read_ranks(VOCABULARY)]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 12))) for _ in range(3000)]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} \n{chr(c)}\n  x" for c in [*range(0x300), *range(0x2000, 0x2100), 0x1F600, 0xFFFD]]
    texts += [c * n for c in (" ", "\n", "-", "a", " \n", "=-") for n in (1, 2, 7, 63, 64, 500)]
    for text in texts:
        ids = encoder(text).tolist()
        assert ids == tiktoken_encoding.encode_ordinary(text), repr(text)
        assert decoder(ids) == text.encode()


def test_ids_offsets_and_split_characters(awkward):
    rows = byte_bpe.encode(awkward, VOCABULARY, public_tokenizers.PATTERN)
    assert rows.count() == awkward.count()
    smile = [r for r in rows.collect() if r.doc_id == 7][0]
    assert smile.ends[-1] == len("été \U0001f600 x́ あ".encode())
    assert len(smile.ends) == len(smile.ids) and smile.ends == sorted(smile.ends)
    back = byte_bpe.decode(rows, VOCABULARY)
    text = {r.doc_id: r.t for r in back.withColumn("t", byte_bpe.decoded_text(back.decoded)).collect() if r.doc_id is not None}
    assert text[7] == "été \U0001f600 x́ あ" and text[2] == "" == text[3]
    first = byte_bpe.decode(rows.selectExpr("doc_id", "slice(ids, 1, greatest(size(ids) - 1, 0)) ids"), VOCABULARY)
    cut = first.where("doc_id = 7").select(byte_bpe.decoded_text(first.decoded)).head()[0]
    assert cut.startswith("été")  # the last character may be cut in half


def test_digests(docs_of, nothing, tiktoken_encoding):
    texts = {1: "Hello, world!  It's 12 o'clock.\n\n", 2: None, 3: "x" * 5000}
    got = {r.doc_id: r for r in byte_bpe.digests(docs_of(list(texts.items())), VOCABULARY, public_tokenizers.PATTERN).collect()}
    for key, text in texts.items():
        ids = tiktoken_encoding.encode_ordinary(text or "")
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.digests(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def reshared(sizes, weights, cap):
    """Targets by repeated sharing, as the definition reads."""
    total, capped = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(capped.values()), [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return {**share, **{s: float(v) for s, v in capped.items()}}
        capped.update({s: cap * sizes[s] for s in over})


def test_targets_and_taken_words(docs_of):
    draw = random.Random(2)
    rows = [(k, " ".join(["w"] * draw.choice([1, 3, 10, 80, 500])), draw.choice(["b", "a10", "a9", None, "é"] + ["hot"] * 5)) for k in range(600)]
    rows += [(1000 + k, "one two", "tiny") for k in range(3)]
    got = mixture.accounts(docs_of(rows)).collect()
    by_id = {r[0]: r for r in rows}
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = by_id[r.doc_id][2]
        assert r.size == len(by_id[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = reshared(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 0.5
    assert all(r.source_size == sizes[by_id[r.doc_id][2]] for r in got)


def test_tree_keeps_quotas_and_fills_shards(spark):
    quota = spark.createDataFrame([("=a", 500), ("=b", 37), ("=c", 1), ("~", 486)], "src string, blocks bigint")
    tree = mixture.splitting_tree(quota, 16)
    assert {r.src: r.n for r in tree.groupBy("src").agg({"n": "sum"}).toDF("src", "n").collect()} == {"=a": 500, "=b": 37, "=c": 1, "~": 486}
    assert [r.n for r in tree.groupBy("shard").agg({"n": "sum"}).toDF("shard", "n").collect()] == [64] * 16
    spread = [r.n for r in tree.where("src = '=a'").collect()]
    assert len(set(spread)) > 3  # drawn, not dealt evenly
    blocks = mixture.shard_of_block(tree, quota)
    assert blocks.count() == 1024 == blocks.select("src", "block").distinct().count()


def test_the_tree_s_blocks_take_the_words(docs_of, monkeypatch):
    """Draws are the blocks of the tree: whole blocks a shard, equal ones a source; without a block its words are not taken."""
    draw = random.Random(6)
    rows = [(k, " ".join(["w"] * draw.choice([1, 9, 70, 3000])), draw.choice("abc")) for k in range(200)]
    kept = {}
    deal = mixture.shard_of_block
    monkeypatch.setattr(mixture, "shard_of_block", lambda *a: kept.setdefault("blocks", deal(*a)))
    docs = docs_of(rows)
    got = mixture.accounts(docs).collect()
    shard = {(r.src, r.block): r.shard for r in kept["blocks"].collect()}
    source = {k: "=" + s for k, _, s in rows}
    words = {}
    for r in got:
        assert r.taken == sum(d.words for d in r.drawn) and (not r.drawn or r.first_shard == r.drawn[0].shard)
        for d in r.drawn:
            assert d.shard == shard[source[r.doc_id], d.block] and d.words > 0
            words[source[r.doc_id], d.block] = words.get((source[r.doc_id], d.block), 0) + d.words
    assert set(words) == set(shard)
    for s in set(source.values()):
        per = [n for (name, _), n in words.items() if name == s]
        assert max(per) - min(per) <= 1
    lost = max(words)
    monkeypatch.setattr(mixture, "shard_of_block", lambda *a: deal(*a).where(f"not (src = '{lost[0]}' and block = {lost[1]})"))
    assert sum(r.taken for r in mixture.accounts(docs).collect()) == sum(r.taken for r in got) - words[lost]


def test_a_source_of_one_very_long_document_stays(docs_of):
    """Its target is far under half of it; the mix names the shard of every row."""
    rows = [(1, "w " * 5000, "a")] + [(10 + k, "w " * 100, "b") for k in range(20)] + [(50, "w " * 9000, "c")]
    mix = mixture.mixed(docs_of(rows), weights=(1.0, 5.0, 0.5), shard_col="at").collect()
    assert {r.source for r in mix} == {"a", "b", "c"} and all(0 <= r["at"] < mixture.SHARDS for r in mix)


def test_mix_is_repeatable_and_handles_awkward_rows(awkward, nothing):
    a = sorted(map(str, mixture.accounts(awkward).collect()))
    assert a == sorted(map(str, mixture.accounts(awkward.repartition(7)).collect())) and len(a) == awkward.count()
    assert mixture.accounts(nothing).count() == 0 and mixture.mixed(nothing).count() == 0
    mix = mixture.mixed(awkward)
    assert mix.columns == awkward.columns
    assert mix.where("text is null or text = ''").count() == 0


def test_no_words_at_all(docs_of):
    rows = mixture.accounts(docs_of([(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
