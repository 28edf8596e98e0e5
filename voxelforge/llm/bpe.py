"""Byte-level BPE encoding and decoding.

A pattern cuts a text into matches.  Within a match a segment tree over its byte positions holds the rank
of the pair that starts at each live position; the root gives the lowest rank, going left on ties gives
the leftmost, and a merge updates the two neighbours and the absorbed position in logarithmic time.

Short matches that are new are merged side by side, a tree each in the rows of one array, longer ones one by
one.  Texts are cut where no match crosses; Arrow numbers the distinct stretches of a slice of texts, each is
encoded and decoded once, and the results are put in place by a gather.

Edge cases: a null or empty text has no ids (empty digests' input).  Every row is encoded for itself, so
repeated rows repeat.  Very long texts and very long matches are encoded whole.  Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import GAP, OTHER, arrow, assemble, byte_kinds, claim, distinct, id_text, texts_of

CODED = "doc_id long, n_tokens long, ids string, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = 1 << 60
_NO_KEY = np.int64(2**63 - 1)
#: Strings that a worker remembers, beyond which its cache starts anew, and the longest string that it remembers.
CACHE_PIECES, CACHE_BYTES = 600_000, 64
_STATE: dict = {}
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xE1] = _VISIBLE[0xE4:0xF5] = True


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bpe(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = get(piece[i : i + 2], NONE)
    for node in range(width - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        node = width + i
        tree[node] = rank
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a <= b else b
            if tree[node] == low:
                break
            tree[node] = low

    while tree[1] != NONE:
        node = 1
        while node < width:
            node *= 2
            if tree[node] > tree[node + 1]:
                node += 1
        i = node - width
        j = after[i]
        k = after[i] = after[j]
        put(j, NONE)
        if k < n:
            before[k] = i
            put(i, get(piece[i : after[k]], NONE))
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            put(h, get(piece[h:k], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Forest:
    """The same segment trees for many short matches side by side: every step merges one pair of each."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for whole, rank in ranks.items():
            for i in range(1, len(whole)):
                a, b = ranks.get(whole[:i]), ranks.get(whole[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.found = np.append(np.array(keys, np.int64)[order], _NO_KEY), np.append(np.array(found, np.int64)[order], NONE)
        self.byte = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pair, NONE where there is none (a negative part is no part)."""
        key = np.where((a < 0) | (b < 0), -1, a << 32 | np.maximum(b, 0))
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.found[at], NONE)

    def encode(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their number by piece); no piece is longer than ``width``, a power of two."""
        n, size = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        part = np.full((n, width + 1), -1, np.int64)  # the last column is nowhere
        part[:, :width] = np.where(inside, self.byte[raw], -1)
        after = np.minimum(np.arange(1, width + 2), size[:, None])
        after = np.where(after == size[:, None], width, after)
        before = np.tile(np.array([width, *range(width)]), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:-1] = self.rank(part[:, : width - 1], part[:, 1:width])
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live, row = inside.copy(), np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            node = np.ones(len(row), np.int64)
            while node[0] < width:
                node *= 2
                node += tree[row, node] > tree[row, node + 1]
            i = node - width
            part[row, i] = tree[row, node]
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            live[row, j] = False
            after[row, i], before[row, k], after[row, width] = k, i, width
            tree[row, width + j] = NONE
            tree[row, node] = self.rank(part[row, i], part[row, k])
            first = h < width
            tree[row[first], width + h[first]] = self.rank(part[row[first], h[first]], part[row[first], i[first]])
            for leaf, own in ((node, row), (width + j, row), (width + h[first], row[first])):
                up = leaf >> 1
                while len(own) and up[0]:
                    tree[own, up] = np.minimum(tree[own, 2 * up], tree[own, 2 * up + 1])
                    up = up >> 1
            row = row[tree[row, 1] < NONE]
        return part[:, :width][live], live.sum(1)


class Codec:
    """Encoder and decoder of one vocabulary, with a cache of stretches between cuts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.words = {v: k for k, v in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.forest = Forest(self.ranks)
        self.parts: dict[bytes, tuple[bytes, int, bytes]] = {}

    def matches(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every match."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > 64:
                out[i] = bpe(p, self.ranks)
            else:
                groups.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, own in groups.items():
            for a in range(0, len(own), 16384):
                some = own[a : a + 16384]
                ids, count = self.forest.encode([pieces[i] for i in some], width)
                ids, end = ids.tolist(), np.cumsum(count).tolist()
                for i, x, y in zip(some, [0, *end[:-1]], end, strict=True):
                    out[i] = ids[x:y]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def learn(self, new: list[bytes], plain: list[bool]) -> list[tuple[bytes, int, bytes]]:
        """(decimal ids, each followed by a space, their number, the bytes that they decode to) of stretches."""
        pieces = [[w] if p else [m.encode() for m in self.find(w.decode())] for w, p in zip(new, plain, strict=True)]
        coded, at, out = self.matches([m for own in pieces for m in own]), 0, []
        for own in pieces:
            ids = [i for m in coded[at : at + len(own)] for i in m]
            at += len(own)
            out.append(("".join([f"{i} " for i in ids]).encode(), len(ids), self.decode(ids)))
        return out

    def code(self, texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """(number of ids, decimal ids joined by a space, decoded bytes) of each text."""
        if len(self.parts) > CACHE_PIECES:
            self.parts.clear()
        buf = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        cut, kind = cuts(buf, ends)
        at = np.flatnonzero(cut)
        index, words = distinct(buf, at)
        is_plain = np.zeros(len(words), bool)
        if len(index):
            is_plain[index] = np.maximum.reduceat(kind, at[:-1]) < OTHER
        own = list(map(self.parts.get, words))
        new = [i for i, x in enumerate(own) if x is None]
        for i, x in zip(new, self.learn([words[i] for i in new], is_plain[new].tolist()), strict=True):
            own[i] = x
            if len(words[i]) <= CACHE_BYTES:
                self.parts[words[i]] = x
        ids, left = assemble([x[0] for x in own], index)
        back, right = assemble([x[2] for x in own], index)
        count = np.concatenate(([0], np.cumsum(np.array([x[1] for x in own], np.int64)[index])))
        stop = np.searchsorted(at, ends)
        start = np.concatenate(([0], stop[:-1]))
        for a, b in zip(start.tolist(), stop.tolist(), strict=True):
            yield int(count[b] - count[a]), bytes(ids[left[a] : max(left[a], left[b] - 1)]), bytes(back[right[a] : right[b]])


def cuts(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that no match crosses, kinds of the bytes; a stretch of kinds below OTHER is one match).

    ``ends`` are the ends of the texts in ``buf``, which are cuts as well.
    Cuts are before a space or line feed that a visible character follows (of white space before a visible
    character the pattern always leaves the last one apart), after such a line feed, and between letters,
    digits and signs.  Bytes that may begin white space beyond ASCII are not counted as visible, which only
    makes stretches longer.
    """
    cut = np.zeros(len(buf) + 1, bool)
    cut[0] = cut[ends] = True
    if not len(buf):
        return cut, buf
    kind, _ = byte_kinds(buf)
    kind[(kind == GAP) & (buf != 32)] = OTHER
    last = np.zeros(len(buf) + 1, bool)
    last[ends - 1] = True  # what follows is another text's (-1 of leading empty texts is nowhere)
    seen = _VISIBLE[buf[1:]] & ~last[: len(buf) - 1]
    a, b = kind[:-1], kind[1:]
    line = (buf[:-1] == 10) & seen
    cut[:-2] |= ((buf[:-1] == 32) & seen) | line
    cut[1:-1] |= line | ((a != b) & (np.minimum(a, b) != GAP) & (np.maximum(a, b) != OTHER))
    return cut, kind


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _STATE:
        _STATE[path, pattern] = Codec(path, pattern)
    return _STATE[path, pattern]


def _run(docs: DataFrame, path: str, pattern: str, digests: bool) -> DataFrame:
    named = DIGESTS if digests else CODED
    schema = arrow(named)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", _STATE.clear)
        own = codec(path, pattern)
        for batch in batches:
            for doc, texts in texts_of(batch, owner="bpe"):
                n, left, right = [], [], []
                for count, ids, back in own.code(texts):
                    n.append(count)
                    left.append(hashlib.sha256(ids).hexdigest() if digests else ids.decode())
                    right.append(hashlib.sha256(back).hexdigest() if digests else back)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((doc, n, left, right), schema, strict=True)], schema=schema)

    return id_text(docs).mapInArrow(work, named)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by a space), decoded bytes."""
    return _run(docs, path, pattern, digests=False)


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """As ``encode_decode`` with SHA-256 digests in place of ids and bytes, so that neither leaves its task."""
    return _run(docs, path, pattern, digests=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
