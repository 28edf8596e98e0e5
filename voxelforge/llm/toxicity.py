"""Toxicity with a linear-chain conditional random field over words.

The labels speak of documents, so the words of a bounded sample are labelled first: a word of a toxic
document is toxic when it, or its four-letter prefix, is common in toxic documents and all but absent
from the others.  A two-state chain (clean, toxic) is then trained on these labelled words; its features
are the word, its prefixes, suffix and length.  Forward-backward marginals of every word of the
whole text are summed up to a document's score by a logistic model, and words with a marginal of at least
one half are the offending spans.

The classifier is fitted on at most ``SAMPLE`` (clean, toxic) labelled documents, those with the smallest
hashes of their ids, less those of more than a hundredth of ``SAMPLE_CHARS``; scoring covers everything.

Very long texts are read whole, words of any length count.  An empty table gives an empty result.

Edge cases: null and empty texts have no words and get the score of a document without toxic words.  Rows
without a label are only scored.  Several labels of one document count as rows of their own.  Without
both labels to learn from, all scores are 0.  Extra columns are ignored; repeated rows repeat; of rows that
share a labelled doc_id every different text is an example of its own.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, slices, small_batches

#: Labelled documents to fit on: clean and toxic ones at most, and their characters at most.
SAMPLE, SAMPLE_CHARS = (3000, 800), 9_000_000
#: Words that a task remembers, beyond which its cache starts anew, and the longest word that it remembers.
CACHE_WORDS, CACHE_CHARS = 600_000, 64
SCORED = "doc_id long, held_out boolean, score double, predicted int, n_toxic long, spans string"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def clean(word: str) -> str:
    return _EDGE.sub("", word).lower()


def features(word: str) -> tuple[str, ...]:
    """Names of a cleaned word's features: the word, three prefixes, a suffix and its length."""
    return ("w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "s" + word[-3:], f"n{min(len(word), 12)}")


class Chain:
    """Two states, so one log-odds number per word carries the forward and the backward messages."""

    def __init__(self, weights: dict[str, float], trans: np.ndarray, head: np.ndarray):
        self.weights, self.trans, self.head = weights, trans, head  # trans: log potentials [from, to]; head: logistic (bias, sum, max)
        self.cache: dict[str, float] = {}

    def emission(self, words: list[str]) -> np.ndarray:
        known, own = self.cache, {}
        if len(known) > CACHE_WORDS:
            known.clear()
        get = self.weights.get
        for w in set(words).difference(known):
            (known if len(w) <= CACHE_CHARS else own)[w] = sum([get(f, 0.0) for f in features(clean(w))])
        each = (known[w] if w in known else own[w] for w in words) if own else map(known.__getitem__, words)
        return np.fromiter(each, np.float64, len(words))

    def messages(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the forward (with the word itself) and backward messages, (words, texts); e and mask are padded at the right."""
        t = np.exp(self.trans)
        step = lambda x, num0, num1, den0, den1: np.log((num0 + x * num1) / (den0 + x * den1))
        n, m = e.shape
        fwd, bwd = np.zeros((m, n)), np.zeros((m, n))
        cols, live = np.ascontiguousarray(e.T), np.ascontiguousarray(mask.T)
        a = np.zeros(n)
        for i in range(m):
            a = cols[i] + (step(np.exp(np.clip(a, -40, 40)), t[0, 1], t[1, 1], t[0, 0], t[1, 0]) if i else 0.0)
            fwd[i] = a
        b = np.zeros(n)
        for i in range(m - 2, -1, -1):
            x = np.exp(np.clip(cols[i + 1] + b, -40, 40))
            b = np.where(live[i + 1], step(x, t[1, 0], t[1, 1], t[0, 0], t[0, 1]), 0.0)
            bwd[i] = b
        return fwd, bwd

    def marginals(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """P(toxic) of each word."""
        fwd, bwd = self.messages(e, mask)
        return (mask / (1 + np.exp(-np.clip((fwd + bwd).T, -40, 40)))).astype(np.float64)

    def pair_marginals(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """[a, b, text, i]: P(word i is in state a and word i + 1 in state b), 0 beyond the text."""
        fwd, bwd = self.messages(e, mask)
        left, right = np.clip(fwd[:-1].T, -40, 40), np.clip((e.T + bwd)[1:].T, -40, 40)
        weight = np.stack([[self.trans[a, b] + a * left + b * right for b in (0, 1)] for a in (0, 1)])
        weight = np.exp(weight - weight.max((0, 1)))
        return weight / weight.sum((0, 1)) * mask[:, 1:]

    def score(self, total: np.ndarray, most: np.ndarray) -> np.ndarray:
        z = self.head[0] + self.head[1] * np.log1p(total) + self.head[2] * most
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def tag(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text index, marginals of its words), texts of like length together."""
        words = [self.emission(t.split()) for t in texts]
        order = sorted(range(len(texts)), key=lambda i: len(words[i]))
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and j - i < 512 and (j - i + 1) * len(words[order[j]]) <= max(400_000, len(words[order[j]])):
                j += 1
            some, i = order[i:j], j
            width = len(words[some[-1]])
            e, mask = np.zeros((len(some), width)), np.zeros((len(some), width), bool)
            for r, k in enumerate(some):
                e[r, : len(words[k])], mask[r, : len(words[k])] = words[k], True
            p = self.marginals(e, mask) if width else e
            for r, k in enumerate(some):
                yield k, p[r, : len(words[k])]


def label_words(texts: list[str], toxic: list[int]) -> tuple[list[list[str]], set[str]]:
    """Cleaned words of every text, and the words taken as toxic in toxic documents."""
    docs = [[sys.intern(clean(w)) for w in t.split()] for t in texts]
    count = [Counter(), Counter()]
    n = [max(1, toxic.count(0)), max(1, toxic.count(1))]
    for words, y in zip(docs, toxic, strict=True):
        own = {w for w in words if w}
        count[y].update(own | {w[:4] + "*" for w in own if len(w) > 4})

    share = math.log(n[1] / (n[0] + n[1]))

    def bad(a: int, b: int) -> bool:
        if a < 3 or a / n[1] <= 30 * b / n[0]:
            return False
        chance = math.lgamma(a + b + 1) - math.lgamma(a + 1) - math.lgamma(b + 1) + a * share
        return chance < math.log(1e-6)  # so many of its documents are toxic by chance

    likely = {x for x, a in count[1].items() if bad(a, count[0][x])}
    around: dict[str, set] = {x: set() for x in likely}  # copies of one document repeat a word's neighbours
    for words, y in zip(docs, toxic, strict=True):
        for i, w in enumerate(words) if y else ():
            for x in (w, w[:4] + "*"):
                if x in around:
                    around[x].add((words[i - 1] if i else "", *words[i + 1 : i + 2]))
    likely = {x for x in likely if bad(min(count[1][x], len(around[x])), count[0][x])}
    return docs, {w for w in {w for d in docs for w in d if w} if w in likely or (len(w) > 4 and w[:4] + "*" in likely)}


def fit(texts: list[str], toxic: list[int], epochs: int = 3, rate: float = 0.3, seed: int = 5) -> Chain:
    """Train the chain by stochastic gradients of the log-likelihood, then the document score."""
    model = Chain({}, np.zeros((2, 2)), np.array([-40.0, 0.0, 0.0]))
    if len(set(toxic)) < 2:
        return model
    docs, bad = label_words(texts, toxic)
    rng = np.random.default_rng(seed)
    spans, width = [], 48
    stems = {w[:4] for w in bad}
    for words, y in zip(docs, toxic, strict=True):  # runs of words: all with a toxic or a similar one, and some others
        for i in range(0, len(words), width):
            own = words[i : i + width]
            if y and any(w in bad for w in own):
                spans.append((own, [int(w in bad) for w in own]))
            elif (not y and any(w[:4] in stems for w in own)) or rng.random() < 0.1:
                spans.append((own, [0] * len(own)))
    number: dict[str, int] = {}
    memo = {w: [number.setdefault(f, len(number)) for f in features(w)] for w in sorted({w for own, _ in spans for w in own})}
    weights, grad2, trans2 = np.zeros(len(number)), np.full(len(number), 1e-2), np.full((2, 2), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for k in range(0, len(order), 64):
            some = [spans[i] for i in order[k : k + 64]]
            m = max(len(w) for w, _ in some)
            f, y, mask = np.zeros((len(some), m, 6), np.int64), np.zeros((len(some), m)), np.zeros((len(some), m), bool)
            for r, (w, lab) in enumerate(some):
                f[r, : len(w)] = [memo[x] for x in w]
                y[r, : len(w)], mask[r, : len(w)] = lab, True
            e = weights[f].sum(2) * mask
            p = model.marginals(e, mask)
            own, at = np.unique(f[mask], return_inverse=True)
            g = np.bincount(at.ravel(), np.repeat((y - p)[mask], 6), minlength=len(own)) / len(some) - 1e-5 * weights[own]
            grad2[own] += g * g
            weights[own] += rate * g / np.sqrt(grad2[own])
            both = mask[:, 1:]
            pairs, t = model.pair_marginals(e, mask), np.zeros((2, 2))
            for a in (0, 1):  # observed pairs minus expected ones
                for b in (0, 1):
                    ya, yb = (y if a else 1 - y)[:, :-1], (y if b else 1 - y)[:, 1:]
                    t[a, b] = (ya * yb * both).sum() - pairs[a, b].sum()
            t /= max(1, both.sum())
            trans2 += t * t
            model.trans = np.clip(model.trans + rate * t / np.sqrt(trans2), -2, 2)
    model.weights = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 0.01}
    total, most = np.zeros(len(texts)), np.zeros(len(texts))
    for i, p in model.tag(texts):
        total[i], most[i] = p.sum(), p.max(initial=0)
    x = np.stack([np.ones(len(texts)), np.log1p(total), most], 1)
    y = np.array(toxic, float)
    h = np.zeros(3)
    for _ in range(3000):
        h += 0.5 * (x.T @ ((y - 1 / (1 + np.exp(-np.clip(x @ h, -40, 40)))))) / len(y) - 1e-4 * h
    model.head = h
    return model


def sample_rows(docs: DataFrame, labels: DataFrame, allowed: Column, per_label: tuple[int, int] = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """At most ``per_label`` (clean, toxic) texts and ``chars`` characters, by smallest hash of doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(allowed & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = None
    for y in (0, 1):
        some = own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label[y])
        picked = some if picked is None else picked.union(some)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(picked), "doc_id").select("toxic", F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("n"), "text")
    rows = rows.where(F.col("n") <= chars // 100)
    order = ["h", "doc_id", "key", "toxic"]
    first = rows.select(*order, "n").distinct().orderBy(*order).limit(sum(per_label))
    used = first.withColumn("used", F.sum("n").over(Window.orderBy(*order))).where(F.col("used") <= chars).select("doc_id", "key", "toxic")
    got = rows.join(F.broadcast(used), ["doc_id", "key", "toxic"]).groupBy(*order).agg(F.min("text").alias("text")).collect()  # at most ``chars`` characters
    got.sort(key=lambda r: (r["h"], r["doc_id"], r["key"], r["toxic"]))
    return [r["text"] for r in got], [r["toxic"] for r in got]


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, number of toxic words, their spans (start:end, code points)."""
    small_batches(docs.sparkSession)
    held = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    shared_model = docs.sparkSession.sparkContext.broadcast(fit(*sample_rows(docs, labels, ~held)))  # bounded by the sample, whatever the input
    form = arrow(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        for batch in batches:
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for own, texts in slices(ids, [t or "" for t in batch.column(2).to_pylist()], 2_000_000):
                total, most, n, where = np.zeros(len(texts)), np.zeros(len(texts)), [0] * len(texts), [""] * len(texts)
                for i, p in model.tag(texts):
                    total[i], most[i] = p.sum(), p.max(initial=0)
                    bad = np.flatnonzero(p >= 0.5)
                    if len(bad):
                        at = [m.span() for m in re.finditer(r"\S+", texts[i])]
                        n[i], where[i] = len(bad), ",".join(f"{at[b][0]}:{at[b][1]}" for b in bad)
                score = model.score(total, most)
                cols = ([x for x, _ in own], [x for _, x in own], score, (score >= 0.5).astype(np.int32), n, where)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, form, strict=True)], schema=form)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels of those whose crc32 of the id is divisible by 5 are never learned from."""
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), out)
