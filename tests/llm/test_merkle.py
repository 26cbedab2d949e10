import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from obsgauge.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text=...):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is ... else text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k:k + 3]) for k in range(0, len(last), 3)])
    return levels


def plain_path(levels, at):
    path = []
    for level in levels[:-1]:
        low = at // 3 * 3
        path.append(("".join(level[low:at]), "".join(level[at + 1:low + 3])))
        at //= 3
    return path


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    by = defaultdict(list)
    for row in rows:
        by[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda x: x[:3])
        trees[name] = plain_levels([x[2] for x in by[name]])
    top = plain_levels([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(by[name]):
            path = plain_path(trees[name], at) + plain_path(top, place)
            start = leaf
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                start = plain_leaf(row, row["text"].replace("\n", ""))
            for left, right in path:
                start = h(left, start, right)
            root = top[-1][0]
            out.append((row["doc_id"], leaf, trees[name][-1][0], root, h(*[a + b for a, b in path]), start, start == root))
    return sorted(out, key=repr)


def check(docs):
    got = sorted((tuple(r) for r in merkle.digest(docs).collect()), key=repr)
    assert got == plain_manifest([r.asDict() for r in docs.select(*merkle.FIELDS).collect()])
    return got


def test_blocks_of_a_large_source_and_small_ones(spark, docs_of):
    draw = random.Random(5)
    sizes = {"hot": 2300, "one": 1, "two": 2, "three": 3, "four": 4, "ten": 10, "edge": 729, "over": 730, "ümlaut": 5, "Z": 28, None: 7}
    rows, key = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            key += draw.randint(1, 3)
            rows.append((key, draw.choice(["", "a\nb", "text", "\n", None]), source))
    draw.shuffle(rows)
    got = check(docs_of(rows))
    assert {r[-1] for r in got} == {True, False}


def test_awkward_rows(awkward, nothing):
    check(awkward)
    assert merkle.digest(nothing).count() == 0


def test_one_row_is_its_own_root(docs_of):
    (row,) = merkle.digest(docs_of([(1, "alone")])).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("")


def test_proofs_fold_to_the_root_and_changed_leaves_do_not(docs_of):
    rows = merkle.proofs(docs_of([(k, f"t{k}", f"s{k % 5}") for k in range(100)]))
    good = rows.where(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count()
    bad = rows.where(merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count()
    assert (good, bad) == (100, 0)
