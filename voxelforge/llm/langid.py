"""Language identification with hyperdimensional profiles.

Every letter (code point) has a random vector of +1 and -1, drawn from its number.  A trigram binds its letters: the first vector permuted
twice, the second once, the third as it is, multiplied component by component.  A text bundles (adds) its
trigrams' vectors, a language's prototype bundles its training texts, and a text gets the language whose
prototype has the largest cosine with it.

Letters of all scripts are lower-cased, everything else is a word gap.

Edge cases: texts that are null or hold no letter get ``und`` and score 0.  Ties go to the language that
sorts first.  Rows are judged one by one, so repeated rows repeat.  Very long texts are read whole.  With
nothing to learn from every text is ``und``, and ``keep_known`` keeps every text with a letter.  Extra
columns are kept by ``keep_known`` and ignored by ``language_id``.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, claim, mix, small_batches

#: Components of a vector, and trigrams whose vectors a task remembers.
DIM, TABLE = 512, 65_536
#: Bits of a letter's number in the table.
BITS = 7
PROFILE = "lang string, sums binary"
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
#: (distinct trigrams from which it holds, least cosine of a known language): short texts score low by chance.
LIMITS = ((1, 0.0), (30, 0.08), (60, 0.13), (120, 0.24), (200, 0.3), (400, 0.42))
#: Least share of letters in the characters that are not blank.
LETTERS = 0.15
_STATE: dict = {}


def _alphabet() -> np.ndarray:
    """Whether a code point is a letter."""
    if "alphabet" not in _STATE:
        _STATE["alphabet"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _STATE["alphabet"]


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A vector of +1 and -1 for every code point, drawn from it alone; 0 stands for a gap between words."""
    seed = letters.astype(np.uint64)[:, None] * np.uint64(2 * DIM // 64) + np.arange(DIM // 64, dtype=np.uint64)
    bits = np.unpackbits(mix(mix(seed + np.uint64(0x9E3779B97F4A7C15))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _padded(sym: np.ndarray) -> np.ndarray:
    """Letters between single gaps (0), with a gap at either end; none without a letter."""
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)  # runs of gaps are one gap
    sym = sym[keep]
    if not sym.any():
        return sym[:0]
    return np.concatenate((np.zeros(int(sym[0] > 0), sym.dtype), sym, np.zeros(int(sym[-1] > 0), sym.dtype)))


def trigrams(text: str) -> np.ndarray:
    """The trigrams of a text, 21 bits a letter; none without a letter."""
    sym = code_points(text.lower()).astype(np.int64)
    sym[~_alphabet()[sym]] = 0
    sym = _padded(sym)
    return sym[:-2] << 42 | sym[1:-1] << 21 | sym[2:]


def trigram_vectors(kind: np.ndarray) -> np.ndarray:
    """Bound vectors of distinct trigrams."""
    three = [letter_vectors(kind >> shift & 0x1FFFFF) for shift in (42, 21, 0)]
    return np.roll(three[0], 2, 1) * np.roll(three[1], 1, 1) * three[2]


class Known:
    """Trigrams that a task remembers: rows of a bounded table, found by numbers of BITS bits that letters get as they come.

    Texts with letters beyond 2**BITS kinds are counted without it.
    """

    def __init__(self):
        self.number = np.where(_alphabet(), -1, 0).astype(np.int32)  # of a code point; a gap is 0, a letter not met yet -1
        self.letters = [0]
        self.table = np.empty((TABLE, DIM), np.int8)
        self.kinds = np.empty(TABLE, np.int64)
        self.row, self.used = np.full(1 << 3 * BITS, -1, np.int32), 0

    def numbers(self, text: str) -> np.ndarray | None:
        """The number of each letter and 0 for each gap; None if some letter has none."""
        code = code_points(text.lower())
        out = self.number[code]
        if (out < 0).any():
            new = np.unique(code[out < 0])[: (1 << BITS) - len(self.letters)]
            self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters += new.tolist()
            out = self.number[code]
        return None if (out < 0).any() else out

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows of the distinct trigrams in order, their counts); None for a text to be counted without the table."""
        sym = self.numbers(text)
        if sym is None:
            return None
        at = _padded(sym)
        code = at[:-2] << 2 * BITS | at[1:-1] << BITS | at[2:]
        row = self.row[code]
        if len(row) and row.min() < 0:
            new = np.unique(code[row < 0])
            if len(new) > TABLE // 4:  # not worth remembering
                return None
            if self.used + len(new) > TABLE:
                self.row.fill(-1)
                self.used = 0
                return self.counted(text)
            letter, mask = np.array(self.letters, np.int64), (1 << BITS) - 1
            kind = letter[new >> 2 * BITS] << 42 | letter[new >> BITS & mask] << 21 | letter[new & mask]
            own = slice(self.used, self.used + len(new))
            self.kinds[own], self.table[own] = kind, trigram_vectors(kind)
            self.row[new] = np.arange(own.start, own.stop)
            self.used = own.stop
            row = self.row[code]
        count = np.bincount(row, minlength=1)
        found = np.flatnonzero(count)
        found = found[np.argsort(self.kinds[found])]
        return found, count[found]


def profile(text: str, damped: bool = False) -> tuple[np.ndarray | None, int]:
    """(sum of the trigram vectors, number of distinct trigrams); ``damped``: one that comes n times counts 1 + log n times, so that repeated phrases do not hide the rest."""
    if "known" not in _STATE:
        _STATE["known"] = Known()
    known = _STATE["known"]
    got = known.counted(text)
    if got is not None:
        kind, count = got
        vectors = lambda at: known.table[at]  # noqa: E731  (bytes: workers side by side wait for memory)
    else:
        kind, count = np.unique(trigrams(text), return_counts=True)
        vectors = trigram_vectors
    if not len(kind):
        return None, 0
    weight, out = (1 + np.log(count) if damped else count).astype(np.float32), np.zeros(DIM, np.float32)
    for i in range(0, len(kind), 4096):
        out += weight[i : i + 4096] @ vectors(kind[i : i + 4096]).astype(np.float32)
    return out, len(kind)


def bundle(text: str, damped: bool = False) -> np.ndarray | None:
    """Sum of the trigram vectors, see ``profile``."""
    return profile(text, damped)[0]


def prototypes(train: DataFrame, damped: bool = False) -> dict[str, np.ndarray]:
    """lang -> normalised bundle of all its texts, from rows (lang, text); ``damped``: texts of any length count alike, too."""
    form = arrow(PROFILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", _STATE.clear)
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = bundle(text.as_py() or "", damped)
                if v is not None and damped:
                    v = v * (2**20 / max(1e-9, float(np.linalg.norm(v))))
                if v is not None:
                    total[lang] = total.get(lang, 0) + np.rint(v).astype(np.int64)
        names = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[x].tobytes() for x in names], pa.binary())], schema=form)

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [key[0]], "sums": [sum(np.frombuffer(b, np.int64) for b in pdf["sums"]).tobytes()]})

    parts = train.mapInArrow(run, PROFILE)
    some = parts.withColumn("s", F.pmod(F.hash("sums"), F.lit(64))).groupBy("lang", "s").applyInPandas(add, PROFILE)
    out = {}
    for r in some.collect():  # 64 rows of DIM numbers a language at most
        out[r["lang"]] = out.get(r["lang"], 0) + np.frombuffer(r["sums"], np.int64)
    return {k: v / max(1e-9, float(np.linalg.norm(v.astype(float)))) for k, v in sorted(out.items())}


def language_id(docs: DataFrame, train: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: cosine with the nearest prototype, negative ones as 0."""
    small_batches(docs.sparkSession)
    protos = prototypes(train)
    names = list(protos)
    matrix = np.array([protos[x] for x in names]).reshape(len(names), DIM)
    form = arrow(OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", _STATE.clear)
        for batch in batches:
            ids, held, texts = (batch.column(i) for i in range(3))
            lang, score = [], []
            for text in texts:
                v = bundle(text.as_py() or "") if names else None
                if v is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                cos = matrix @ v / max(1e-9, float(np.linalg.norm(v)))
                best = int(np.argmax(cos))
                lang.append(names[best])
                score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(lang), pa.array(score, pa.float64())], schema=form)

    held = F.lit(False) if held_out is None else held_out
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def letter_share(text: str) -> float:
    code = code_points(text)
    return np.count_nonzero(_alphabet()[code]) / max(1, np.count_nonzero(code > 32))


def limit(n: int) -> float:
    """Least cosine of a text with n distinct trigrams."""
    return next((least for start, least in reversed(LIMITS) if n >= start), 0.0)


def keep_known(docs: DataFrame, train: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with some letter and, if there is a prototype, the share of letters and cosine asked for."""
    small_batches(docs.sparkSession)
    protos = prototypes(train, damped=True)
    matrix = np.array(list(protos.values())).reshape(len(protos), DIM)

    def known(text: str) -> bool:
        v, n = profile(text, damped=True)
        return v is not None and (not protos or letter_share(text) >= LETTERS and float((matrix @ v).max()) >= limit(n) * float(np.linalg.norm(v)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", _STATE.clear)
        for batch in batches:
            yield batch.filter(pa.array([known(t.as_py() or "") for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose crc32 of the id leaves 1 modulo 3 are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return language_id(docs, docs.where(~out & F.col("lang").isNotNull()).select("lang", "text"), out)
