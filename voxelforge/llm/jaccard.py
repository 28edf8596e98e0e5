"""Exact n-gram Jaccard join with count-vector R-trees.

Tokens (k-word shingles) are hashed into groups.  For two sets with Jaccard similarity >= num/den the
symmetric difference is at most D, so of D + 1 or more groups one has the same content in both.  The
content hashes of the groups therefore *route* documents: only documents that share a group's content
can be linked.  Among the documents of a route the counts of (coarser or finer) groups are points of an
R-tree.  A node whose coordinate-wise maxima bound the overlap below the threshold is cut off; documents
joined by surviving pairs form clusters.  Within a cluster (or two blocks of a large one) another tree
proposes pairs, and these are verified on the full sets.  A set holds 64-bit hashes (cut from BLAKE2) of
its shingles, so sizes and overlaps are exact up to chance collisions.

Edge cases: a null or empty text has an empty set, is its own component and links with nothing.  With
fewer than k words the whole sequence is the one shingle.  Nodes are texts, named by 64 bits of
their SHA-256 (N^2 / 2^65 expected pairs taken for one), so rows that share a doc_id keep their own
sets and links; only the reported component unites all texts of a doc_id.  Rows without a doc_id link
nothing in ``ngram_jaccard`` and get no component; ``keep_one`` compares their texts like all others and
prefers a copy that has a doc_id.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, components, cut, mix, rows, shingle_sets, slices, small_batches, texts_of

_U = np.uint64
POINT = 64  # coordinates of a point
LEAF = 32  # points in a leaf
#: Shingles that one task holds at most, per side (8 bytes each).
BLOCK_SHINGLES = 1_500_000
#: Documents of one route that are compared at once in a task, and in a batch of a task before the shuffle.
ROUTE_ROWS, BATCH_ROWS = 4096, 16
#: Bits of a route's key: 48 keep chance meetings rare up to 10**13 routes, and zero bytes cost nothing in the shuffle.
KEY_BITS = _U(0xFFFFFFFFFFFF0000)
#: Keys of large groups that a task remembers.
HEADS = 20_000
#: Largest table of document ids that may be broadcast (16 bytes a row).
BROADCAST_ROWS = 500_000
#: A digest of more than one in HOT rows is hot, so fewer than HOT are, whatever the input: they may be broadcast.
HOT = 4096
CLASS_SCHEMA = "doc_id long, id long, n long, digest binary"
ROUTE_SCHEMA = "key long, a long, b long"
POINT_SCHEMA = "a long, point binary"
EDGE_SCHEMA = "a long, b long"


def size_class(n: int, num: int, den: int) -> int:
    """Classes whose bounds grow by den/num, so linked sets lie in one class or in neighbours."""
    return int(np.floor(np.log(n) / np.log(den / num) + 1e-9))


@cache
def class_groups(c: int, num: int, den: int) -> tuple[int, int]:
    """(number of groups, spare) for sets of classes c and c + 1.

    D bounds the symmetric difference of two linked sets from these classes; groups = D + 1 + spare leaves
    at least 1 + spare equal groups, so groups that are empty in both may be ignored up to ``spare`` times.
    """
    ratio = den / num
    low, high = ratio ** (c + 1), ratio ** (c + 2)
    most = 0
    for a, b in ((low, high), (high, high)):  # a <= b, b <= a / threshold
        least = num * (a + b) / (num + den)
        most = max(most, a + b - 2 * least)
    most = int(most + 1e-9) + 1
    groups = most + 1
    for _ in range(6):
        empty = groups * np.exp(-(ratio**c) / groups)
        spare = int(np.ceil(empty + 4 * np.sqrt(empty)))
        groups = most + 1 + spare
    return groups, spare


def routes(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Content hashes of the groups of one set, for its own class and the class below."""
    c, out = size_class(len(tokens), num, den), []
    for level in (c, c - 1):
        if level < 0:
            continue
        groups, spare = class_groups(level, num, den)
        salt = _U(level * 0x9E3779B97F4A7C15 % 2**64)
        code = mix(tokens + salt)
        where = (code >> _U(33)).astype(np.int64) % groups
        order = np.argsort(where.astype(np.uint16) if groups < 1 << 16 else where, kind="stable")  # the short kind is sorted by digits
        where = where[order]
        at = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        filled, sums = where[at], np.add.reduceat(code[order], at)
        out.append(mix(sums ^ (filled.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)) ^ salt))
        if groups - len(filled) > spare:  # rare: only such sets can agree on more empty groups than are spare
            none = np.setdiff1d(np.arange(groups), filled).astype(np.uint64)
            out.append(mix((none + _U(1)) * _U(0xA0761D6478BD642F) ^ salt))
    return np.concatenate(out) & KEY_BITS


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of tokens in POINT groups."""
    out = np.zeros((len(sets), POINT), np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> _U(58)).astype(np.int64), minlength=POINT)
    return out


class CountTree:
    """R-tree over count vectors: leaves of LEAF points in order of size, then inner nodes of LEAF children.

    Only the upper corner of a node's box and its smallest and largest set size are needed.
    """

    def __init__(self, pts: np.ndarray):
        size = pts.sum(1)
        peak = pts.argmax(1)
        self.order = np.lexsort((peak, size))
        self.pts, self.size = pts[self.order], size[self.order]
        self.levels = []
        top, low, high = self.pts, self.size, self.size
        while len(top) > 1 or not self.levels:
            at = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Indices of points whose summed minima with q allow num/den similarity."""
        n = int(q.sum())
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -2, -1):
            if depth >= 0:
                top, low, high = (x[at] for x in self.levels[depth])
            else:
                top, low = self.pts[at], self.size[at]
                high = low
            ok = (den * high >= num * n) & (den * n >= num * low)
            at, top, low = at[ok], top[ok], low[ok]
            least = np.maximum(low, -(-num * n // den))  # the smallest set that can still link
            both = np.minimum(top, q).sum(1)
            at = at[(num + den) * both >= num * (n + least)]
            if depth > 0:
                below = len(self.levels[depth - 1][0])
            elif depth == 0:
                below = len(self.pts)
            else:
                break
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        return self.order[at]


def link_block(sets: list[np.ndarray], start: list[int], num: int, den: int) -> np.ndarray:
    """Component index of each set.  ``start``: sets with equal values are known to be connected.

    A breadth-first search: every set asks the tree once for sets not reached yet, so pairs inside a part
    that is already known are never verified, and no pairs are listed.
    """
    n = len(sets)
    pts = points(sets)
    tree = CountTree(pts)
    flat = np.concatenate(sets) if n else np.empty(0, np.uint64)
    _, token = np.unique(flat, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(sizes)))
    flag = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)
    mates: dict[int, list[int]] = {}
    for i, s in enumerate(start):
        mates.setdefault(s, []).append(i)
    part, open_ = np.full(n, -1), np.ones(n, bool)
    for seed in range(n):
        if not open_[seed]:
            continue
        queue = list(mates[start[seed]])
        open_[queue] = False
        part[queue] = seed
        while queue:
            q = queue.pop()
            near = tree.search(pts[q], num, den)
            near = near[open_[near]]
            if not len(near):
                continue
            own = token[at[q] : at[q + 1]]
            flag[own] = True
            for i in range(0, len(near), 512):
                some = near[i : i + 512]
                some = some[open_[some]]
                if not len(some):
                    continue
                lens = sizes[some]
                cum = np.cumsum(lens) - lens
                idx = np.arange(int(lens.sum())) - np.repeat(cum, lens) + np.repeat(at[some], lens)
                both = np.add.reduceat(flag[token[idx]].astype(np.int64), cum)
                for j in some[den * both >= num * (lens + sizes[q] - both)]:
                    if open_[j]:
                        more = mates[start[j]]
                        open_[more] = False
                        part[more] = seed
                        queue.extend(more)
            flag[own] = False
    return part


def text_key(text: Column) -> Column:
    """The node of a text: 64 bits of its SHA-256, so that no two texts can be made to share one."""
    return F.conv(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 16), 16, -10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """id (the node), text, doc_id."""
    small_batches(docs.sparkSession)
    return docs.select(text_key(F.col("text")).alias("id"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))


def classes(texts: DataFrame, k: int) -> DataFrame:
    """doc_id, id, n (set size), digest of the set (null when empty)."""
    out = arrow(CLASS_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest = [], []
            for _, own in texts_of(batch, lower=True):
                sets = shingle_sets(own, k)
                size += [len(s) for s in sets]
                digest += [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            yield rows(out, (batch.column(2).cast(pa.int64()), batch.column(0), size, digest))

    return texts.mapInArrow(run, CLASS_SCHEMA)


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join with a table that has a key once; the rows of ``left`` with hot keys stay where they are."""
    if hot is None:
        hot = cut(left.groupBy(key).count().where(F.col("count") * HOT > left.count()).select(key))
    hot = F.broadcast(hot)
    usual = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, "left")
    return usual.unionByName(left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, "left"))


def route_rows(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Rows (key, a, null): document a has a group content key; rows (., a, b): a and b share one.

    More than BATCH_ROWS documents of a key in a batch are tied to the smallest of them at once, and so are
    those of later batches of the task, so that a large group sends one row per task and key to the shuffle.
    """
    out = arrow(ROUTE_SCHEMA)

    def emit(keys: np.ndarray, docs_: np.ndarray, heads: dict[int, int]) -> pa.RecordBatch:
        order = np.lexsort((docs_, keys))
        keys, docs_ = keys[order], docs_[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
        which = np.cumsum(first) - 1
        head = docs_[first][which] if len(keys) else docs_
        large = np.bincount(which, minlength=1)[which] > BATCH_ROWS if len(keys) else first
        known = np.zeros(len(keys), bool)
        if heads:
            hot = np.array(sorted(heads), np.uint64)
            at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            known = hot[at] == keys
            head = np.where(known, np.array([heads[k] for k in hot.tolist()], np.int64)[at], head)
        for k, h in zip(keys[first & large & ~known].tolist(), head[first & large & ~known].tolist(), strict=True):
            if len(heads) < HEADS:
                heads[k] = h
        tie = (large | known) & (docs_ != head)
        pair = np.unique(np.stack([head[tie], docs_[tie]], 1), axis=0) if tie.any() else np.empty((0, 2), np.int64)
        first = (first | ~large) & ~known
        apart = mix(pair.astype(np.uint64) @ np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64))
        key = np.concatenate((keys[first].view(np.int64), apart.view(np.int64)))
        a = np.concatenate((docs_[first], pair[:, 1]))
        b = pa.array(np.concatenate((docs_[first], pair[:, 0])), mask=np.concatenate((np.ones(int(first.sum()), bool), np.zeros(len(pair), bool))))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), b], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, int] = {}  # keys that were large in a batch, with the document that stands for them in this task
        for batch in batches:
            keys, own, held, met = [], [], 0, set()
            for ids, some in texts_of(batch, lower=True):
                for i, s in zip(ids, shingle_sets(some, k), strict=True):
                    if len(s) and i not in met:
                        met.add(i)
                        r = routes(s, num, den)
                        keys.append(r)
                        own.append(np.full(len(r), i, np.int64))
                        held += len(r)
                if held > 400_000:
                    yield emit(np.concatenate(keys), np.concatenate(own), heads)
                    keys, own, held = [], [], 0
            if keys:
                yield emit(np.concatenate(keys), np.concatenate(own), heads)

    return texts.mapInArrow(run, ROUTE_SCHEMA)


def fine_point(tokens: np.ndarray) -> bytes:
    """Counts of a set in a power of two of groups, about four tokens each; the first byte is the item size."""
    bits = max(6, int(np.ceil(np.log2(max(1, len(tokens) / 4)))))
    count = np.bincount((tokens >> _U(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.uint8 if count.max(initial=0) < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + count.astype(kind).tobytes()


def same_width(points_: list[bytes]) -> np.ndarray:
    """Points as rows; finer ones are added up to the width of the coarsest."""
    raw = [np.frombuffer(p, np.uint8 if p[0] == 1 else np.uint32, offset=1) for p in points_]
    width = min(len(r) for r in raw)
    return np.stack([r.astype(np.int32) if len(r) == width else r.reshape(width, -1).sum(1, dtype=np.int32) for r in raw])


def bound_parts(pts: np.ndarray, num: int, den: int, start: list[int]) -> np.ndarray:
    """Components of points whose summed minima allow the similarity; each is named by its first row.

    ``start``: points with equal values are known to be connected.  A breadth-first search that tries only points
    not reached yet, so points that are all near each other are tried once.
    """
    size = pts.sum(1, dtype=np.int64)
    part, open_ = np.full(len(pts), -1), np.arange(len(pts))
    own = np.unique(start, return_inverse=True)[1]
    while len(open_):
        seed = open_[0]
        hit = own[open_] == own[seed]
        queue, open_ = open_[hit].tolist(), open_[~hit]
        part[queue] = seed
        while queue and len(open_):
            q = queue.pop()
            n, other = size[q], size[open_]
            near = open_[(den * other >= num * n) & (den * n >= num * other)]
            found = [near[:0]]
            for i in range(0, len(near), 512):
                some = near[i : i + 512]
                both = np.minimum(pts[some], pts[q]).sum(1, dtype=np.int32).astype(np.int64)
                found.append(some[(num + den) * both >= num * (n + size[some])])
            if len(near := np.concatenate(found)):
                hit = np.isin(own[open_], own[near])
                queue += open_[hit].tolist()
                part[open_[hit]] = seed
                open_ = open_[~hit]
    return part


def route_edges(routed: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) edges inside every route from its rows (key, a, point), which must be sorted by key within partitions."""
    form = arrow(EDGE_SCHEMA)

    none = np.empty(0, np.int64)

    def group(ids: np.ndarray, pts: list[bytes], up: dict[int, int], seen: set) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one route that this task has not found yet; near copies share many routes."""

        def root(i: int) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = up.get(j, j)
                i = j
            return i

        own = ids.tolist()
        roots = [root(i) for i in own]
        if len(set(roots)) == 1 or (name := hash(tuple(own))) in seen:
            return none, none
        if len(seen) > 500_000:
            seen.clear()
        seen.add(name)
        wide = same_width(pts)
        if len(ids) == 2:
            n, both = wide.sum(1, dtype=np.int64), int(np.minimum(wide[0], wide[1]).sum())
            part = np.array([0, 0 if (num + den) * both >= num * n.sum() else 1])
        else:
            part = bound_parts(wide, num, den, roots)
        new = np.flatnonzero(part != np.arange(len(part)))
        for i in new.tolist():
            up[root(own[i])] = root(own[part[i]])
        return ids[new], ids[part[new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, pts, up, seen = none, none, [], {}, set()
        for batch in _then_none(batches):
            if batch is not None:
                keys = np.concatenate((keys, batch.column(0).to_numpy()))
                ids = np.concatenate((ids, batch.column(1).to_numpy()))
                pts += batch.column(2).to_pylist()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()] if len(keys) else []
            ends = [*cuts[1:], len(keys)] if cuts else []
            left, right, done = [], [], 0
            for i, j in zip(cuts, ends, strict=True):
                if j == len(keys) and batch is not None and j - i < ROUTE_ROWS:
                    break  # the route may go on in the next batch
                for c in range(i, j, ROUTE_ROWS):  # a longer route: pieces, whose first documents are tied as they are
                    a, b = group(ids[c : min(c + ROUTE_ROWS, j)], pts[c : min(c + ROUTE_ROWS, j)], up, seen)
                    left.append(a)
                    right.append(b)
                if j - i > ROUTE_ROWS:
                    left.append(ids[i + 1 : j])
                    right.append(np.full(j - i - 1, ids[i]))
                done = j
                if j == len(keys) and batch is not None:  # keep one document of a route that goes on
                    done = j - 1
                    left.append(ids[i + 1 : j])
                    right.append(np.full(j - i - 1, ids[i]))
            keys, ids, pts = keys[done:], ids[done:], pts[done:]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], schema=form)

    return routed.mapInArrow(run, EDGE_SCHEMA)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def fine_points(docs: DataFrame, k: int) -> DataFrame:
    form = arrow(POINT_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in texts_of(batch, lower=True):
                yield rows(form, (ids, [fine_point(x) for x in shingle_sets(texts, k)]))

    return docs.mapInArrow(run, POINT_SCHEMA)


def _block_parts(k: int, num: int, den: int):
    """(doc, part, text) of one block -> (doc, part) with parts joined; part is a document of it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node")
        raw = [(t or "").encode().lower() for t in pdf.pop("text")]
        sets = [s for _, own in slices(raw, raw) for s in shingle_sets(own, k)]
        part = link_block(sets, pdf["part"].tolist(), num, den)
        first = pdf.groupby(part)["part"].transform("min")
        return pd.DataFrame({"a": pdf["part"].to_numpy(np.int64), "b": first.to_numpy(np.int64)}).drop_duplicates()

    return run


def text_nodes(known: DataFrame) -> DataFrame:
    """id, n, digest, copies (rows), and the first row: none (no doc_id), doc_id, same (rows like it)."""
    each = known.where("digest is not null").groupBy("id", "doc_id").agg(F.min("n").alias("n"), F.min("digest").alias("digest"), F.count("*").alias("same"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("first")
    return cut(each.groupBy("id").agg(F.min("n").alias("n"), F.min("digest").alias("digest"), F.sum("same").alias("copies"), first).select("id", "n", "digest", "copies", "first.*"))


def text_parts(texts: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, root): components of the texts by links with Jaccard similarity >= num/den."""
    reps = nodes.groupBy("digest").agg(F.min("id").alias("rep"))
    of = cut(join_hot(nodes.select("id", "n", "digest"), reps, "digest").select("id", "rep", "n"))
    first = nodes.select("id", F.col("doc_id").alias("first"), "same")

    def first_rows(picked: DataFrame, small: bool) -> DataFrame:
        """The rows of texts in ``picked``, of each only the first one or those like it."""
        picked = picked.withColumnRenamed("id", "node")
        return texts.join(F.broadcast(picked) if small else picked, (F.col("id") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first")))

    found = route_rows(texts, k, num, den)
    rep = of.select(F.col("id").alias("a"), F.col("rep").alias("ra"))
    route = Window.partitionBy("key")
    often = found.withColumn("n", F.count("*").over(route)).where("n > 1 OR b IS NOT NULL")
    # routes of the same texts lead to the same pairs, so one is enough: they get one key (if others get it by chance, more pairs are tried)
    often = often.withColumns({"low": F.min("a").over(route), "high": F.max("a").over(route), "all": F.bit_xor("a").over(route)}).where("low < high OR b IS NOT NULL")
    often = often.withColumn("key", F.when(F.col("b").isNull(), F.xxhash64("n", "low", "high", "all")).otherwise(F.col("key")))
    routed = cut(often.join(rep, "a").select("key", F.col("ra").alias("a"), "b").distinct())
    # rows of one key that are copies of each other have become one row
    members = routed.where("b IS NULL").select(F.col("a").alias("id")).distinct().join(first, "id")
    few = members.count() <= BROADCAST_ROWS
    pts = fine_points(first_rows(members, few).select("id", "text"), k).dropDuplicates(["a"])
    ordered = routed.where("b IS NULL").join(pts, "a").select("key", "a", "point").repartition("key").sortWithinPartitions("key", "a")
    known_b = routed.where("b IS NOT NULL").select("a", "b").join(rep.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b").select("a", F.col("rb").alias("b"))
    pairs = route_edges(ordered, num, den).union(known_b).where("a <> b")
    tied = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    clusters = components(tied)

    held = clusters.join(of.select(F.col("id").alias("node"), "n"), "node")
    total = held.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("blocks"))
    held = held.join(total, "component").select(F.col("node").alias("id"), "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    held = cut(held.join(first, "id"))
    body = first_rows(held, held.count() <= BROADCAST_ROWS).select("node", "component", "blocks", "block", "same", "text")
    if not held.where("same > 1").isEmpty():
        body = body.where("same = 1").union(body.where("same > 1").dropDuplicates(["node"]))
    body = body.drop("same")

    work = _block_parts(k, num, den)
    alone = cut(body.withColumn("part", F.col("node")).groupBy("component", "block").applyInPandas(work, "a long, b long"))
    links = alone
    wide = held.where("blocks > 1")
    if not wide.isEmpty():
        links = _across_blocks(body.where("blocks > 1"), wide.join(of.select(F.col("id"), "n"), "id"), alone, work)
    linked = components(links).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    return cut(join_hot(of.select("id", "rep"), linked, "rep").select("id", F.coalesce("root", "rep").alias("root")))


def _across_blocks(body: DataFrame, members: DataFrame, links: DataFrame, work) -> DataFrame:
    """Links of clusters of several blocks, given those inside every block.

    First one document of every part of a block meets those of the other blocks.  Of each cluster the largest
    part that this gives is then at peace with itself; all other documents, in blocks of their own, meet
    every block.
    """

    def parts(links: DataFrame) -> DataFrame:
        own = components(links).select(F.col("node").alias("pn"), F.col("component").alias("part"))
        return cut(members.join(own, F.col("id") == F.col("pn")).select("id", "component", "part", "n"))

    def blocks(some: DataFrame, name: str) -> DataFrame:
        total = some.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).alias("count"))
        return some.join(total, "component").withColumn(name, F.pmod(F.xxhash64("id"), F.col("count"))).withColumnRenamed("count", f"{name}s")

    now = parts(links)
    first = blocks(now.where("id = part"), "meet").select(F.col("id").alias("node"), "part", "meet")
    links = cut(links.union(body.join(first, "node").groupBy("component", "meet").applyInPandas(work, "a long, b long")))
    now = parts(links)
    sizes = now.groupBy("component", "part").agg(F.sum("n").alias("size"))
    main = sizes.groupBy("component").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    rest = cut(blocks(now.join(main, "component").where("part <> main"), "other").select(F.col("id").alias("node"), "other", "others", "component"))
    if rest.isEmpty():
        return links
    known = body.join(now.select(F.col("id").alias("node"), "part"), "node")
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    mine = known.join(rest.select("node", "other"), "node").select("component", "node", "part", "text", "other", each("blocks", "block"))
    theirs = known.join(rest.select("component", "others").distinct(), "component").select("component", "node", "part", "text", each("others", "other"), "block")
    return links.union(cut(theirs.unionByName(mine).groupBy("component", "block", "other").applyInPandas(work, "a long, b long")))


def ngram_jaccard(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: components of the links with Jaccard similarity >= num/den."""
    texts = keyed(docs)
    known = cut(classes(texts, k))
    named = known.where("doc_id is not null")
    nodes = text_nodes(named)
    roots = text_parts(texts.where("doc_id is not null"), nodes, k, num, den)
    several = cut(named.select("doc_id", "id").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id"))
    united = not several.isEmpty()
    if united:  # doc_ids with several texts tie the components of these texts
        pairs = named.select("doc_id", "id").distinct().join(several, "doc_id").withColumn("doc", F.xxhash64(F.lit("doc"), "doc_id"))
        ties = cut(components(join_hot(cut(pairs), roots, "id").where("root is not null").select(F.col("root").alias("a"), F.col("doc").alias("b"))))
        roots = cut(join_hot(roots, ties.select(F.col("node").alias("root"), "component"), "root").select("id", F.coalesce("component", "root").alias("root")))
    roots = cut(roots.join(nodes.select("id", "doc_id"), "id"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = cut(join_hot(roots.select("id", "root"), least, "root"))
    out = join_hot(known, of.select("id", "component_id"), "id").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    if united:  # also for their texts without shingles
        own = ties.join(of.groupBy("root").agg(F.min("component_id").alias("least")), F.col("component") == F.col("root")).select(F.col("node").alias("doc"), "least")
        named = several.withColumn("doc", F.xxhash64(F.lit("doc"), "doc_id")).join(own, "doc").select("doc_id", "least")
        out = join_hot(cut(out), named, "doc_id").withColumn("component_id", F.coalesce("least", "component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows and columns of ``docs``, one row (the smallest doc_id) of every component of texts.

    Of rows that agree in doc_id and text one stays.  Texts without shingles are no copies of each other.
    """
    texts = keyed(docs)
    known = cut(classes(texts, k))
    nodes = text_nodes(known)
    roots = text_parts(texts, nodes, k, num, den)
    best = roots.join(nodes, "id").groupBy("root").agg(F.min(F.struct("none", "doc_id", "id")).alias("best"))
    judged = nodes.join(best.select("best.id", F.lit(True).alias("stays")), "id", "left").where("stays is null or copies > 1")
    judged = cut(judged.select(F.col("id").alias("__id"), "copies", F.coalesce("stays", F.lit(False)).alias("__stays"), F.col("doc_id").alias("__first")))
    own = docs.withColumns({"__id": text_key(F.col("text")), "__doc": F.col("doc_id").cast("long")})
    verdict = judged.drop("copies")
    if judged.count() <= BROADCAST_ROWS:
        kept = own.join(F.broadcast(verdict), "__id", "left")
    else:
        kept = join_hot(own, verdict, "__id", judged.where(F.col("copies") * HOT > known.count()).select("__id"))
    kept = kept.where(F.col("__stays").isNull() | (F.col("__stays") & F.col("__doc").eqNullSafe(F.col("__first"))))
    twice = known.where("doc_id is not null or digest is not null").groupBy("id", "doc_id").count().where("count > 1")
    twice = cut(twice.select(F.col("id").alias("i"), F.col("doc_id").alias("d")))
    if not twice.isEmpty():
        like = (F.col("__id") == F.col("i")) & F.col("__doc").eqNullSafe(F.col("d"))
        kept = kept.join(twice, like, "left_anti").unionByName(kept.join(twice, like, "left_semi").dropDuplicates(["__id", "__doc"]))
    return kept.select(docs.columns)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at 0.9 over 3-word shingles of all documents."""
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws)=0 THEN []::VARCHAR[] WHEN len(ws)<3 THEN [array_to_string(ws,' ')]
    ELSE list_transform(range(1, len(ws)-1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g=b.g AND a.doc_id<>b.doc_id GROUP BY 1,2),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id=i.a JOIN n y ON y.doc_id=i.b WHERE 100*c >= 90*(x.n+y.n-c)),
r(d, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.t=l.a)
SELECT d.doc_id, coalesce(n.n,0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(t) AS c FROM r GROUP BY d) m ON m.d=d.doc_id
"""
