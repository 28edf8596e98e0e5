"""Periodic runs of words, found by internal pattern matching, and texts with the repetitions collapsed.

A run is a stretch of words whose smallest period q is the distance of identical words, at least
max(6, 4 q) words long, that no neighbouring word extends.  The words of a text are cut into dyadic
blocks of 2**k words.  A run of period q, 2**k <= q < 2**(k + 1), holds such a block whose copy begins
in the window of starts 2**k to 2**(k + 1) words on.  The block's copies are a range of the suffix array;
a wavelet tree over that array gives the range's successors in the window.  Up to two copies are candidate
periods themselves.  Three or more lie in one arithmetic progression, whose two stretches, that of the
block and that of its copies, end a period apart; that distance is the candidate.  Candidates are extended
to both sides by the ranks of the blocks, so every reported run is exact, and none is lost.
Periods below 8, whose windows hold at most four starts, are found by comparing the words directly, and
texts without any repeated block of eight words need no suffix array.

Edge cases: null and empty texts have no words and no runs, and their collapsed text is empty.  Rows are
judged one by one, so repeated rows repeat their result.  Very long texts are read whole; a text takes
about 8 bytes a word and doubling of the block, at most some 200 bytes a word.  Of equally long runs the
first counts as the longest.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, assemble, id_text, texts_of

LEAST, TIMES = 6, 4
#: Periods below it are compared word by word; blocks of the suffix array have as many words at least.
DIRECT = 8
NONE = 1 << 62
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class WaveletTree:
    """Counts and order statistics of ranges of a sequence of numbers below 2**bits, for many ranges at once."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1 == 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[~bit], values[bit]))

    def below(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        """How many values of each range are below v."""
        count, whole = np.zeros(len(lo), np.int64), hi - lo
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = (v >> b) & 1 == 1
            low, high = ones[lo], ones[hi]
            count += np.where(up, (hi - high) - (lo - low), 0)
            lo, hi = np.where(up, zeros + low, lo - low), np.where(up, zeros + high, hi - high)
        return np.where(v >> self.bits > 0, whole, count)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of each range, or NONE where it has fewer."""
        none, out = k >= hi - lo, np.zeros(len(lo), np.int64)
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            low, high = ones[lo], ones[hi]
            n = (hi - high) - (lo - low)
            up = k >= n
            k = np.where(up, k - n, k)
            out |= up.astype(np.int64) << b
            lo, hi = np.where(up, zeros + low, lo - low), np.where(up, zeros + high, hi - high)
        return np.where(none, NONE, out)


class Blocks:
    """Ranks of all blocks of 1, 2, 4, ... words of many texts; blocks of different texts differ."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        n = self.n = len(word)
        _, rank = np.unique(doc.astype(np.int64) * (int(word.max(initial=0)) + 1) + word, return_inverse=True)
        self.ranks = [self._ended(rank)]
        longest = int(np.bincount(doc).max(initial=0))
        while 1 << (len(self.ranks) - 1) < longest:
            step, rank = 1 << (len(self.ranks) - 1), self.ranks[-1]
            next_ = np.zeros(n, np.int64)
            if step < n:
                next_[: n - step] = np.where(doc[step:] == doc[: n - step], rank[step:n] + 1, 0)
            kinds, own = np.unique(rank[:n].astype(np.int64) * (n + 1) + next_, return_inverse=True)
            self.ranks.append(self._ended(own))
            if len(kinds) == n:
                break
        self.suffixes = np.argsort(self.ranks[-1][:n], kind="stable")

    @staticmethod
    def _ended(rank: np.ndarray) -> np.ndarray:
        return np.concatenate((rank.astype(np.int32), np.array([-1], np.int32)))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j, i < j, have in common."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            n += (self.ranks[k][i + n] == self.ranks[k][np.minimum(j + n, self.n)]).astype(np.int64) << k
        return n

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and before j that agree."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            at = i - n - (1 << k)
            n += ((at >= 0) & (self.ranks[k][np.maximum(at, 0)] == self.ranks[k][np.maximum(j - n - (1 << k), 0)])).astype(np.int64) << k
        return n


def _short(word: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of the stretches of every period below DIRECT."""
    for q in range(1, min(DIRECT, len(word))):
        same = np.zeros(len(word) - q + 2, np.int8)
        same[1:-1] = (word[q:] == word[:-q]) & (doc[q:] == doc[:-q])
        edge = np.flatnonzero(np.diff(same))
        start, length = edge[0::2], edge[1::2] - edge[0::2] + q
        yield start, length, np.full(len(start), q)


def _long(word: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of stretches of longer periods; ``at`` are the words' numbers in their texts."""
    blocks = Blocks(word, doc)
    n, tree = blocks.n, None
    for k, rank in enumerate(blocks.ranks):
        size = 1 << k
        if size < DIRECT:
            continue
        count = np.bincount(rank[:n])
        i = np.flatnonzero((at % size == 0) & (count[rank[:n]] > 1))
        if not len(i):
            continue
        if tree is None:
            tree = WaveletTree(blocks.suffixes, max(1, n.bit_length()))
        lo = (np.cumsum(count) - count)[rank[i]]
        hi = lo + count[rank[i]]
        before = tree.below(lo, hi, np.minimum(i + size, n))
        first, second, third = (tree.kth(lo, hi, before + m) for m in range(3))
        end = i + 2 * size
        many = third < end
        for j in (first, second):
            some = ~many & (j < end)
            yield from _extended(blocks, i[some], j[some])
        i, j, step = i[many], first[many], (second - first)[many]
        yield from _extended(blocks, i, i + (j + step + blocks.ahead(j, j + step)) - (i + step + blocks.ahead(i, i + step)))


def _extended(blocks: Blocks, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    some = (j > i) & (j < blocks.n)
    i, j = i[some], j[some]
    back = blocks.behind(i, j)
    yield i - back, back + (j - i) + blocks.ahead(i, j), j - i


def runs_of(word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, in order of text, start and period.

    ``word`` numbers the words of all texts, those of text i being ``bounds[i]:bounds[i + 1]``.
    """
    counts = np.diff(bounds)
    doc, at = np.repeat(np.arange(len(counts)), counts), np.arange(len(word)) - np.repeat(bounds[:-1], counts)
    found = list(_short(word, doc))
    again = np.flatnonzero(np.bincount(doc[_repeated(word, doc)], minlength=len(counts))[doc] > 0)
    if len(again):
        found += [(again[s], length, q) for s, length, q in _long(word[again], doc[again], at[again])]
    start, length, period = (np.concatenate([np.asarray(f[c], np.int64) for f in found] or [np.empty(0, np.int64)]) for c in range(3))
    keep = length >= np.maximum(LEAST, TIMES * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])  # of one stretch the smallest period
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return doc[start] if len(start) else start, at[start] if len(start) else start, length, period


def _repeated(word: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Where blocks of DIRECT words begin that their text holds twice (a few more may be named, none is left out)."""
    n = len(word) - DIRECT + 1
    if n <= 0:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        key = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        part = word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
        key = key[:n].copy()
        for i in range(DIRECT):
            key = (key ^ part[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(29)
    order = np.argsort(key)
    twice = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    return order[twice]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), and the text without what repeats inside runs: words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in texts_of(batch):
                words = Words(texts, hashed=False)
                bounds = words.bounds.astype(np.int64)
                doc, start, length, period = runs_of(words.index, bounds)
                drop = np.zeros(len(words.index) + 1, np.int64)
                np.add.at(drop, bounds[doc] + start + period, 1)
                np.add.at(drop, bounds[doc] + start + length, -1)
                keep = np.cumsum(drop[:-1]) == 0
                left = np.concatenate(([0], np.cumsum(keep)))[bounds]
                joined, at = assemble([w + b" " for w in words.values], words.index[keep])
                cut = at[left]
                data = [bytes(joined[a : max(a, b - 1)]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                edges = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts)))))
                parts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts), pa.array(data, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return id_text(docs, id_col, text_col).mapInArrow(run, RUNS)


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of every tenth document made periodic from some word on: a rule on the checksum of the id, for tests at any size.

    A null id leaves its text as it is.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, a, p = F.col("__n"), F.col("__a"), F.col("__p")
    part: Column = F.concat(F.slice("__w", F.lit(1), a), F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil((n - a) / p).cast("int"))))
    made = (
        docs.where(h % 10 == 0).select(F.col(id_col).alias("doc_id"), words.alias("__w"), g.alias("__g")).select("doc_id", "__w", "__g", F.size("__w").alias("__n")).where("__n > 0")
        .select("doc_id", "__w", "__n", "__g", (F.col("__g") % F.col("__n")).cast("int").alias("__a")).withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    )
    empty = (h % 10 == 0) & (F.size(words) > 0)
    return made.select("doc_id", F.array_join(F.slice(part, F.lit(1), n), " ").alias("text")).union(docs.where(~F.coalesce(empty, F.lit(False))).select(F.col(id_col), F.col(text_col)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = collapse_runs(with_periods(docs))
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    best = F.col("best")
    return found.select("doc_id", "n_words", "runs", "collapsed", F.array_max(order).alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"),
        F.floor(F.lit(1000) * best["length"] / -best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
