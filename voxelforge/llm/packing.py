"""Sequence packing: first-fit decreasing with a tournament tree, in randomised groups of documents.

Every document is tokenised once (Arrow numbers the distinct words of a slice of texts, each of which is
encoded once and put in place by a gather), gets an end id, and is cut into pieces of the sequence length;
the pieces of a group are packed by first-fit decreasing.  The tree holds the largest free capacity below
each node, so the first bin that fits is found in logarithmic time.  Groups are random and hold about
``group_docs`` documents, however many there are in all.

Edge cases: a null or empty text is the end id alone.  Rows that repeat a doc_id, and those without one,
are packed each for itself.  Very long texts are cut into as many pieces as they need.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DIGIT, GAP, OTHER, SLICE_BYTES, arrow, assemble, byte_kinds, claim, distinct, id_text, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
GROUPED = PIECES + ", grp long"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"
#: Words that a worker remembers, beyond which its cache starts anew, and the longest word that it remembers.
CACHE_WORDS, CACHE_BYTES = 700_000, 64
_MARK = "<|startoftext|>"
_STATE: dict = {}
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True


class WordEncoder:
    """Ids of distinct stretches, as little-endian uint32 bytes, in the way of the tokeniser.

    Its pre-tokeniser crosses neither white space nor the cuts of ``stretches``, so a text's ids are those
    of its stretches in order.  New plain stretches are encoded together and told apart by the tokens that
    end a word; others are separated by a special token that is cut out again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.mark = self.tok.token_to_id(_MARK)
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        self.last[[i for w, i in self.tok.get_vocab().items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn_plain(self, texts: list[str]) -> list[bytes] | None:
        """Each text is one word to the pre-tokeniser; None if it saw that otherwise."""
        ids = self._ids(" ".join(texts))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(texts) or ends[-1] != len(ids):
            return None
        raw = ids.tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _learn(self, texts: list[str]) -> list[bytes]:
        if self.mark is None or any("<|" in t for t in texts):
            return [self._ids(t).tobytes() for t in texts]
        ids = self._ids(_MARK.join(texts))
        at, raw = np.flatnonzero(ids == self.mark), ids.tobytes()
        return [raw[4 * x : 4 * y] for x, y in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)]

    def encode(self, words: list[bytes], plain: np.ndarray) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        out = list(map(self.known.get, words))
        for kind in (True, False):
            new = [i for i, ids in enumerate(out) if ids is None and plain[i] == kind]
            for a in range(0, len(new), 2000):
                texts = [words[i].decode() for i in new[a : a + 2000]]
                got = (self._learn_plain(texts) if kind else None) or self._learn(texts)
                for i, ids in zip(new[a : a + 2000], got, strict=True):
                    out[i] = ids
                    if len(words[i]) <= CACHE_BYTES:
                        self.known[words[i]] = ids
        return out


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, plain) of the stretches of the texts, each text and a blank after another.

    Stretches end at white space, between ASCII or accented Latin letters, digits and ASCII punctuation, and
    after every digit; not beside an apostrophe or any other character.  Plain ones hold one such kind only.
    Letters are in lower case, which the tokeniser would do; parts that may hold a special token stay.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind, pair = byte_kinds(buf)
    low = buf + np.where(_UPPER[buf], 32, 0).astype(np.uint8)
    low[pair + 1] |= np.where(buf[pair + 1] == 0x9F, 0, 0x20).astype(np.uint8)  # capitals but sharp s
    odd = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
    if len(odd):  # "<|"
        edge = np.flatnonzero(kind == GAP)
        for k in np.unique(np.searchsorted(edge, odd)).tolist():
            a, b = (int(edge[k - 1]) + 1 if k else 0), int(edge[k])
            kind[a:b], low[a:b] = OTHER, buf[a:b]
    a, b = kind[:-1], kind[1:]
    cut = np.flatnonzero(((a != b) & ((np.maximum(a, b) < OTHER) | (np.minimum(a, b) == GAP))) | ((a == DIGIT) & (b == DIGIT))) + 1
    starts = np.concatenate(([0], cut))
    full = kind[starts] != GAP
    ends = np.concatenate((cut, [len(buf)]))[full]
    starts = starts[full]
    plain = np.maximum.reduceat(kind, starts) < OTHER if len(starts) else np.empty(0, bool)
    return low, starts, ends, plain


def word_encoder(path: str) -> WordEncoder:
    if path not in _STATE:
        _STATE[path] = WordEncoder(path)
    return _STATE[path]


def text_ids(texts: list[bytes], encoder: WordEncoder, end_id: int) -> tuple[memoryview, np.ndarray]:
    """(little-endian uint32 ids of all texts, each with its end id, where each text's begin and the last end)."""
    buf, starts, ends, plain = stretches(texts)
    held = np.concatenate(([0], np.cumsum(ends - starts)))
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    index, words = distinct(buf[np.cumsum(inside[:-1], dtype=np.int8) > 0], held)
    is_plain = np.zeros(len(words), bool)
    is_plain[index] = plain
    after = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # stretches up to the end of each text
    values = [*encoder.encode(words, is_plain), np.array([end_id], "<u4").tobytes()]
    raw, at = assemble(values, np.insert(index, after, len(words)))
    return raw, np.concatenate(([0], at[after + np.arange(1, len(texts) + 1)])) // 4


def token_pieces(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, keep_ids: bool = True, groups: int = 1) -> DataFrame:
    """One row per piece; ``ids`` (little-endian uint32) is null unless ``keep_ids``; ``grp`` is a random group.

    A row's group depends on its doc_id, text and partition, so no repeated or null doc_id fills one group.
    """
    schema = arrow(GROUPED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _STATE.clear)
        encoder = word_encoder(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            rows = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for own, some in slices(rows, texts, SLICE_BYTES):
                raw, at = text_ids(some, encoder, end_id)
                total = np.diff(at)
                pieces = -(-total // length)
                which = np.repeat(np.arange(len(own)), pieces)
                start = (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                first = at[:-1][which] + start
                size = np.minimum(length, total[which] - start)
                cuts = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
                crc = [zlib.crc32(x) for x in cuts]
                ids = [bytes(x) for x in cuts] if keep_ids else [None] * len(cuts)
                cols = ([own[i][0] for i in which.tolist()], start, size, crc, total[which], ids, [own[i][1] for i in which.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    own = id_text(docs)
    grp = F.pmod(F.xxhash64(F.lit(20240117), "id", "text", F.spark_partition_id()), F.lit(groups))
    return own.withColumn("grp", grp).mapInArrow(run, GROUPED)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each size, sizes taken from large to small."""
    n = len(sizes)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        offsets[i] = capacity - tree[node]
        bins[i] = node - width
        tree[node] -= size
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a > b else b
    return bins, offsets


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, group_docs: int = 4000, keep_ids: bool = True) -> DataFrame:
    """Pieces with their sequence_id and offset; a sequence lies in one group."""
    groups = max(1, -(-docs.count() // group_docs))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], kind="stable", na_position="first").drop(columns="grp")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return token_pieces(docs, path, length, end_id, keep_ids, groups).groupBy("grp").applyInPandas(place, PLACED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")
