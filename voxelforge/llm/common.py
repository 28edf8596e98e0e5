"""Helpers shared by the training-data operators: word hashing in NumPy, checkpoints, components.

Words are maximal runs of bytes outside space, tab, LF, VT, FF and CR.  Arrow numbers the distinct words
of a slice of texts, so Python code runs once per distinct word; a word's hash is cut from BLAKE2, so no
words with equal hashes can be made up on purpose short of 2**32 trials.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task; bounds the working arrays, never what is read.
SLICE_BYTES = 4_000_000
#: Words whose runs are hashed at once.
STRETCH = 200_000

#: Longest word, and number of words, whose hashes a worker remembers; beyond it the cache starts anew.
CACHE_BYTES, CACHE_WORDS = 64, 200_000

_U = np.uint64
_RNG = np.random.default_rng(20240117)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_KNOWN: dict[bytes, int] = {}


_CACHES: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def claim(owner: str, clear: Callable[[], None]) -> None:
    """A task of an operator with a cache begins: Python workers are reused, so others' caches are dropped."""
    _CACHES[owner] = clear
    if _OWNER[0] != owner:
        for name, drop in _CACHES.items():
            if name != owner:
                drop()
        _OWNER[0] = owner


def claim_words() -> None:
    claim("words", _KNOWN.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (wraps around on purpose)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0x9FB21C651E98DF25)
    return x ^ (x >> _U(32))


def distinct(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(index of every string, the distinct strings) of the strings ``buf[at[i]:at[i + 1]]``."""
    own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(buf)])
    own = own.dictionary_encode()
    return own.indices.to_numpy(), own.dictionary.to_pylist()


def assemble(values: list[bytes], index: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(all of ``values[index]`` joined, where each begins and the last ends)."""
    out = pa.array(values, pa.large_binary()).take(pa.array(index))
    _, at, data = out.buffers()
    at = np.frombuffer(at, np.int64)[out.offset : out.offset + len(index) + 1]
    return memoryview(data) if data is not None else memoryview(b""), at


GAP, LETTER, DIGIT, SIGN, OTHER = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = GAP
_KIND[0x21:0x7F] = SIGN
_KIND[0x30:0x3A], _KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[39] = DIGIT, LETTER, LETTER, OTHER


def byte_kinds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kind of every byte of a UTF-8 text, where accented Latin letters of two bytes begin).

    Kinds: white space, ASCII and accented Latin letters, ASCII digits, ASCII signs, and all else, which
    includes the apostrophe.  Between two of the first four kinds no pretokeniser at hand sees one word.
    """
    kind = _KIND[buf]
    pair = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
    kind[pair] = kind[pair + 1] = LETTER
    return kind, pair


def word_hashes(words: list[bytes]) -> list[int]:
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in words]), "<u8").tolist()


def _pair(a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    return mix(mix(a + _PLACE[place % 64]) + b * _U(0x9E3779B97F4A7C15))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbours of ``h``, made from those of runs of powers of two."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    size, power, out, done = 1, h, None, 0
    while True:
        if k & size:
            at = power[done : done + len(h) - k + 1]
            out, done = (at if out is None else _pair(out, at, size)), done + size
        if 2 * size > k:
            return mix(out + _PLACE[k % 64])
        power, size = _pair(power[: len(power) - size], power[size:], size), 2 * size


class Words:
    """Words of a list of texts: ``hashes`` of all, ``bounds[i]:bounds[i+1]`` those of text i.

    ``values[index]`` are the words themselves; a word's hash is 64 bits of BLAKE2 (none without ``hashed``).
    """

    __slots__ = ("bounds", "ends", "hashes", "index", "starts", "values")

    def __init__(self, texts: list[bytes], hashed: bool = True):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = _SPACE[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(buf) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.index, self.values = distinct(buf[~gap], np.concatenate(([0], np.cumsum(self.ends - self.starts))))
        self.hashes = self._hashed() if hashed else None
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, at)

    def _hashed(self) -> np.ndarray:
        if len(_KNOWN) > CACHE_WORDS:
            _KNOWN.clear()
        hashes = list(map(_KNOWN.get, self.values))
        new = [i for i, h in enumerate(hashes) if h is None]
        for i, h in zip(new, word_hashes([self.values[i] for i in new]), strict=True):
            hashes[i] = h
            if len(w := self.values[i]) <= CACHE_BYTES:
                _KNOWN[w] = h
        return np.array(hashes, np.uint64)[self.index]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text index, word index within the text) of every run of k words inside one text."""
        counts = np.diff(self.bounds)
        n = np.maximum(counts - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        first = np.repeat(np.cumsum(n) - n, n)
        pos = np.arange(len(doc)) - first
        at = self.bounds[:-1][doc] + pos
        every = np.empty(max(0, len(self.hashes) - k + 1), np.uint64)
        for a in range(0, len(every), STRETCH):
            every[a : a + STRETCH] = runs(self.hashes[a : a + STRETCH + k - 1], k)
        return every[at], doc, pos


def slices(ids: list, texts: list, limit: int = SLICE_BYTES, most: int = 4096) -> Iterator[tuple[list, list]]:
    """Cut parallel lists into runs of at most about ``limit`` bytes of text and ``most`` texts."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit or j + 1 - i >= most:
            yield ids[i : j + 1], texts[i : j + 1]
            i, size = j + 1, 0
    if i < len(texts):
        yield ids[i:], texts[i:]


def texts_of(batch: pa.RecordBatch, lower: bool = False, limit: int = SLICE_BYTES, owner: str = "words") -> Iterator[tuple[list, list]]:
    """(ids, UTF-8 texts) of a batch whose first two columns are an id and a text; a null text is empty."""
    if owner == "words":
        claim_words()
    raw = batch.column(1).cast(pa.large_binary()).to_pylist()
    texts = [(t or b"").lower() if lower else (t or b"") for t in raw]
    return slices(batch.column(0).to_pylist(), texts, limit)


def sorted_set(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; with fewer words the whole sequence is one."""
    words = Words(texts)
    grams, doc, _ = words.grams(k)
    counts = np.diff(words.bounds)
    at = np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))))
    out = []
    for i, n in enumerate(counts):
        if n >= k:
            out.append(sorted_set(grams[at[i] : at[i + 1]]))
        elif n:
            own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            out.append(runs(own, int(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def small_batches(spark: SparkSession, most: int = 1024) -> None:
    """Texts are long: fewer rows a batch than Spark's default keep both sides of a Python stage small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, most)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the Python stages read, under fixed names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def shared(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder; the cluster's own setting always wins."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and forget how it was made."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a long, b long): one row (node, component = smallest node).

    Every round hooks each node to its smallest neighbour, follows that pointer once more, and contracts
    the edges; layers of pointers shrink from round to round and are composed at the end.  All state
    stays in Spark tables.  Self loops are kept as single nodes; an empty table gives an empty result.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    layers: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"))
        hook = cut(hook)
        up = hook.select(F.col("v").alias("q"), F.col("p").alias("pp"))
        layer = cut(hook.join(up, hook["p"] == up["q"]).select("v", F.least("p", "pp").alias("p")))
        layers.append(layer)
        left, right = layer.select(F.col("v").alias("a"), F.col("p").alias("pa")), layer.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = live.join(left, "a").join(right, "b").where("pa <> pb")
        live = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    else:
        raise RuntimeError("components did not converge")

    def follow(df: DataFrame, layer: DataFrame) -> DataFrame:
        step = layer.withColumnRenamed("v", "component")
        return df.join(step, "component", "left").select("node", F.coalesce("p", "component").alias("component"))

    return reduce(follow, layers, nodes.withColumn("component", F.col("node")))


def arrow(schema: str) -> pa.Schema:
    """Arrow schema of a short "name type" list; types: long, int, double, string, binary, bool."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


def rows(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
