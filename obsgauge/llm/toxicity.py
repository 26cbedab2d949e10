"""Toxicity by Levenshtein automata over a lexicon trie, with scores of context windows.

Learning (labelled rows of the learning folds, at most ``sample_rows``):

1. Lexicon.  Support of a word is the number of different words before it in toxic
   documents, so a rare word of a copied text counts once.  Word beginnings
   whose support is far above their count in clean documents become entries;
   an entry is lengthened while that keeps nine tenths of its support.  An
   entry stands for all words that begin with it.
2. Clean forms.  Words of clean documents within the allowed edits of an entry
   are noted and never count as its misspellings.
3. Weights.  A logistic regression on a document's hits.

Matching: the entries form a trie.  The automaton's states are sets of (trie
node, edits so far), that is the intersection of the trie with the Levenshtein
automata of all entries; states are made when first met and kept, so a word
costs one look-up a character until the set is empty.  Entries of 5 characters
or more may be misspelled by one edit (a replaced, missing or added character,
or two exchanged); a misspelled word must match to its end.

Context: for every hit the window of ``WINDOW`` characters on both sides is read.  A hit between
quotation marks counts as quoted, with half its weight; hits close to each other
count as abuse on top of their number.

Defined cases: NULL and empty texts have no hits and get the score of a text without hits;
texts are read whole; repeated rows and NULL ids are scored like any row;
without toxic or clean labels every score is 0; empty tables give no rows;
labels other than 0 and 1 teach nothing.  Only id and text are looked at.
The lexicon is broadcast with the task: its size is bounded by the sample.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsgauge.llm.common import held_out, labelled_sample, map_rows
from obsgauge.sources.shared import written

SAMPLE_ROWS = 12_000
SHORTEST, LONGEST = 3, 14  # characters of an entry
LEAST_SUPPORT = 3  # different contexts, and at least one for every hundred toxic texts
LEAST_RATIO = 20.0
FUZZY_FROM = 5
WINDOW = 40
THRESHOLD = 0.5
MEMORY = 50_000  # words whose outcome a task remembers
QUOTES = "\"'`«»‘’‚“”„‹›"
_WORDS = re.compile(r"[^\W_]+")


class Automaton:
    """The trie of the entries and its lazily made product with one-edit automata."""

    def __init__(self, entries: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        for word in entries:
            at = 0
            for c in word:
                at = self.next[at].setdefault(c, len(self.next))
                if at == len(self.entry):
                    self.next.append({})
                    self.entry.append(None)
            self.entry[at] = word
        self.entries = entries
        # For a missing character a state also holds the nodes one further, one edit up.
        start = self._closed({(0, 0, "")})
        self.states: list[frozenset] = [start]
        self.number = {start: 0}
        self.step: list[dict[str, int]] = [{}]
        self.exact: list[str | None] = [self._exact(start)]
        self.fuzzy: list[str | None] = [self._fuzzy(start)]

    def _closed(self, items: set) -> frozenset:
        out = set(items)
        for node, edits, swap in items:
            if edits == 0 and not swap:
                out.update((child, 1, "") for child in self.next[node].values())
        return frozenset(out)

    def _exact(self, state: frozenset) -> str | None:
        found = [self.entry[n] for n, e, s in state if e == 0 and not s and self.entry[n]]
        return max(found, key=len) if found else None

    def _fuzzy(self, state: frozenset) -> str | None:
        found = [self.entry[n] for n, e, s in state if not s and self.entry[n] and len(self.entry[n]) >= FUZZY_FROM]
        return max(found, key=lambda w: (len(w), w)) if found else None

    def follow(self, state: int, c: str) -> int:
        """Number of the next state; -1 if no entry is left.  Items: (node, edits, character owed by an exchange)."""
        out = set()
        for node, edits, owed in self.states[state]:
            if owed:
                if owed == c:
                    out.add((node, 1, ""))
                continue
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, edits, ""))
            if edits == 0:
                out.add((node, 1, ""))  # added character
                for other, below in self.next[node].items():
                    out.add((below, 1, ""))  # replaced character
                    second = self.next[below].get(c)
                    if second is not None:
                        out.add((second, 1, other))  # exchanged pair, the first of it is to come
        made = self._closed(out)
        if not made:
            return -1
        if made not in self.number:
            self.number[made] = len(self.states)
            self.states.append(made)
            self.step.append({})
            self.exact.append(self._exact(made))
            self.fuzzy.append(self._fuzzy(made))
        return self.number[made]

    def match(self, word: str) -> tuple[str, bool] | None:
        """(entry, misspelled) for a lower-case word: the longest beginning, else a misspelling of the whole word."""
        state, found = 0, None
        for c in word:
            to = self.step[state].get(c)
            if to is None:
                to = self.step[state][c] = self.follow(state, c)
            if to < 0:
                state = -1
                break
            state = to
            found = self.exact[state] or found
        if found:
            return found, False
        if state > 0 and self.fuzzy[state]:
            return self.fuzzy[state], True
        return None


class Model:
    def __init__(self, entries: dict[str, float], clean_forms: set[str]):
        self.entries, self.clean_forms = entries, clean_forms
        self.coefficients: list[float] | None = None


class Scorer:
    """Features and score of a text; made once a task."""

    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(model.entries)
        self.known: dict[str, tuple[str, bool] | None] = {}

    def hit(self, word: str):
        if word in self.model.clean_forms:
            return None
        return self.automaton.match(word)

    def features(self, text: str | None) -> list[float]:
        """[weight of exact hits, of misspelled, of quoted, different entries, close hits, share of words], damped."""
        if not text or not self.model.entries:
            return [0.0] * 6
        low = text.lower()
        words = _WORDS.findall(low)
        known, hits = self.known, {}
        for word in set(words):
            if word in known:
                got = known[word]
            else:
                if len(known) >= MEMORY:
                    known.clear()
                got = known[word] = self.hit(word)
            if got:
                hits[word] = got
        if not hits:
            return [0.0] * 6
        sums, last, close, count, kinds = [0.0, 0.0, 0.0], -10 * WINDOW, 0, 0, set()
        for m in _WORDS.finditer(low):
            got = hits.get(m.group())
            if not got:
                continue
            entry, misspelled = got
            before, after = low[max(0, m.start() - WINDOW):m.start()], low[m.end():m.end() + WINDOW]
            quoted = any(before.count(q) % 2 for q in "\"`") and any(q in after for q in "\"`") \
                or any(before.rfind(a) > before.rfind(b) and b in after for a, b in ("«»", "“”", "„“", "‘’", "‹›"))
            sums[2 if quoted else int(misspelled)] += self.model.entries[entry]
            close += m.start() - last <= WINDOW
            last = m.end()
            count += 1
            kinds.add(entry)
        return [math.log1p(s) for s in sums] + [math.log1p(len(kinds)), math.log1p(close), math.sqrt(count / len(words))]

    def score(self, text: str | None) -> float:
        c = self.model.coefficients
        if c is None:
            return 0.0
        z = c[0] + sum(a * b for a, b in zip(c[1:], self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _word_counts(sample: DataFrame) -> DataFrame:
    """(word, toxic, clean): different words before it in toxic texts; clean texts that have it."""

    def start():
        import xxhash

        def row(text, label):
            words = _WORDS.findall(text.lower())
            if label:
                return [(w, xxhash.xxh32_intdigest(p), 1) for w, p in {(w, p) for p, w in zip(["", *words], words)}]
            return [(w, None, 0) for w in set(words)]

        return row

    rows = map_rows(sample.select("text", "label"), "word string, before bigint, toxic int", start, many=True)
    toxic = rows.where("toxic = 1").select("word", "before").distinct().groupBy("word").agg(F.count("*").alias("toxic"), F.lit(0).cast("long").alias("clean"))
    clean = rows.where("toxic = 0").groupBy("word").agg(F.lit(0).cast("long").alias("toxic"), F.count("*").alias("clean"))
    return toxic.unionByName(clean).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries with their weights (log odds, at most 8)."""
    starts = counts.select(F.explode(F.expr(
        f"transform(sequence({SHORTEST}, greatest({SHORTEST}, least({LONGEST}, char_length(word)))), k -> substring(word, 1, k))")).alias("start"), "toxic", "clean")
    starts = starts.where(F.char_length("start") >= SHORTEST).groupBy("start").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1.0)) / ((F.col("clean") + 0.5) / (n_clean + 1.0))
    good = {r.start: (r.toxic, r.odds) for r in starts.withColumn("odds", odds).where(
        (F.col("toxic") >= max(LEAST_SUPPORT, 0.01 * n_toxic)) & (F.col("odds") >= LEAST_RATIO)).collect()}
    below: dict[str, list[str]] = {}
    for word in good:
        below.setdefault(word[:-1], []).append(word)
    entries: dict[str, float] = {}
    for word in sorted(good, key=lambda w: (len(w), w)):
        if any(word[:k] in good for k in range(SHORTEST, len(word))):
            continue  # lengthened from its own beginning
        while longer := [w for w in below.get(word, ()) if good[w][0] >= 0.9 * good[word][0]]:
            word = max(longer, key=lambda w: (good[w][0], w))
        entries[word] = min(8.0, math.log(good[word][1]))
    return entries


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``sample_rows`` labelled documents; the driver sees counts of the lexicon and six numbers a row."""
    import numpy as np

    sample = written(labelled_sample(docs, labels, "toxic", sample_rows, "toxicity"), "toxic-sample")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, set())
    counts = written(_word_counts(sample), "toxic-words")
    model = Model(learn_lexicon(counts, sizes[1], sizes[0]), set())
    if not model.entries:
        return model
    entries = model.entries

    def near():
        automaton = Automaton(entries)
        return lambda word: [(word,)] if (m := automaton.match(word)) and m[1] else []

    model.clean_forms = {r.word for r in map_rows(counts.where("clean > 0").select("word"), "word string", near, many=True).collect()}

    def start():
        scorer = Scorer(model)
        return lambda text, label: (scorer.features(text), label)

    rows = map_rows(sample.select("text", "label"), "x array<double>, label int", start).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows], float)
    model.coefficients = _regression(x, y)
    return model


def _regression(x, y) -> list[float]:
    """Ridge logistic regression by Newton steps.

    Misspelled and quoted hits are rare among the labels; their ridge pulls towards three
    quarters and half of what an exact hit weighs.
    """
    import numpy as np

    prior = np.array([-3.0, 3.0, 2.25, 1.5, 0.5, 0.5, 0.0])
    design = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.array([0.01, *[1.0] * x.shape[1]])

    def loss(w):
        z = design @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * (w - prior) ** 2).sum()

    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + ridge * (w - prior)
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        move, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and loss(w - size * move) > loss(w):
            size /= 2
        w -= size * move
        if np.abs(size * move).max() < 1e-6:
            break
    w[1:] = np.maximum(w[1:], 0)  # a hit never speaks for a text
    return [float(v) for v in w]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): 0 to 1, row by row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        scorer = Scorer(model)
        return lambda key, text: (key, scorer.score(text))

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, score double", start)


def rejected(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` under the threshold, with all their columns."""

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)  # goes with the task: the worker runs other stages after it
        for texts in batches:
            yield pa.array((scorer.score(text.as_py()) for text in texts), pa.float64())

    return docs.where(toxicity(F.col(text_col)) < threshold)


def digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs, fit(docs, labels, **how))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
