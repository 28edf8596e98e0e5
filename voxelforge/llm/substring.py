"""Substring deduplication with prefix-partitioned trees of word suffixes, cut off at the window's depth.

Every word position starts a suffix, of which only the first ``window`` words matter.  A suffix is held as
a 52-bit label of its prefixes: 12 bits of a hash of its first two words, 12 bits of one of its first four,
28 bits of one of the whole window.  Sorted labels are the leaves of a tree with inner nodes at these three
depths.  The deep nodes, those of equal labels, are the repeats of a window; runs of them that go on side by
side in both documents are joined to maximal repeats.  The trees hold hashes instead of words, since the
words of all windows would exceed the disk budget; every repeat is therefore confirmed by its words.

Suffixes are split by prefix: a histogram over all two-word codes is taken first, rare codes share a group
and frequent codes are continued by longer prefixes until a group holds about ``GROUP`` suffixes.  Tasks
send their suffixes as sorted, compressed blocks, after settling those that repeat inside the batch (by
comparing the words): only the occurrences in a batch's smallest document go on, so a passage found
everywhere arrives once per batch.

Repeats between batches are confirmed by 128-bit BLAKE2 digests of the words on both sides.  Where they
differ, two windows have had equal labels by chance: the documents of such labels are grouped anew by the
digests of the windows.  So nothing is removed unless its words come in a smaller document.

Edge cases: null and empty texts and those shorter than a window have no repeats.  Windows that repeat
inside one document only are kept.  Rows that share a doc_id are judged each by its own text, and none marks
another.  A null doc_id neither marks nor is marked.  Extra columns are kept by ``dedupe_texts``, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, arrow, claim, claim_words, cut, mix, slices, small_batches

LABEL_BITS, CODE_BITS, NEXT_BITS = 52, 12, 12
REST_BITS = LABEL_BITS - CODE_BITS
#: Suffixes of one group, about; one group is one tree in a task's memory (28 bytes a suffix).
GROUP = 1_000_000
#: Bytes of text of one batch of a task.
BATCH_BYTES = 4_000_000
#: Largest table of marked rows that may be broadcast (8 bytes a row), and most partitions of the trees.
BROADCAST_ROWS, PARTITIONS = 500_000, 20_000
BLOCKS = "grp long, block binary"
RUNS = "id long, key long, pos long, n long, known boolean, l_id long, l_key long, l_pos long"
DIGESTS = "id long, key long, pos long, n long, digest binary"
KEPT = "id long, n_words long, n_removed long, kept string"
_U = np.uint64


def suffixes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, text index, word position) of every suffix of at least ``window`` words."""
    whole, doc, pos = words.grams(window)
    label = whole >> _U(64 - REST_BITS + NEXT_BITS)
    for k, bits, shift in ((2, CODE_BITS, REST_BITS), (min(4, window), NEXT_BITS, REST_BITS - NEXT_BITS)):
        gram, gram_doc, _ = words.grams(k)
        first = np.searchsorted(gram_doc, np.arange(len(words.bounds) - 1))
        label |= gram[first[doc] + pos] >> _U(64 - bits) << _U(shift)
    return label, doc, pos


def prefix_groups(counts: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, bits of longer prefixes) of every prefix code."""
    base, bits = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    group, held = 0, 0
    for c, n in enumerate(counts.tolist()):
        if n > target:
            if held:
                group, held = group + 1, 0
            base[c], bits[c] = group, int(np.ceil(np.log2(n / target)))
            group += 1 << int(bits[c])
        else:
            if held + n > target:
                group, held = group + 1, 0
            base[c] = group
            held += n
    return base, bits


def pack(columns: list[tuple[np.ndarray, bool]]) -> bytes:
    """Columns of whole numbers as byte planes, compressed; those marked True as differences."""
    head, body = [], []
    for x, rising in columns:
        x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
        head += [len(x), x.dtype.itemsize]
        body.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    return struct.pack(f"<{len(head)}q", *head) + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(raw: bytes, kinds: list[tuple[type, bool]]) -> list[np.ndarray]:
    head = struct.unpack(f"<{2 * len(kinds)}q", raw[: 16 * len(kinds)])
    sizes = [n * size for n, size in zip(head[::2], head[1::2], strict=True)]
    body = zstandard.ZstdDecompressor().decompress(raw[16 * len(kinds) :], max_output_size=max(1, sum(sizes)))
    out, at = [], 0
    for n, size, total, (kind, rising) in zip(head[::2], head[1::2], sizes, kinds, strict=True):
        x = np.ascontiguousarray(np.frombuffer(body[at : at + total], np.uint8).reshape(size, n).T).view(kind).ravel() if n else np.empty(0, kind)
        out.append(np.cumsum(x, dtype=kind) if rising else x)
        at += total
    return out


def write_block(labels: np.ndarray, ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Sorted labels with the row (by its place in ids and keys) and word position of each."""
    used = np.flatnonzero(np.bincount(doc, minlength=len(ids)))
    place = np.zeros(len(ids), np.uint32)
    place[used] = np.arange(len(used))
    return pack([(labels, True), (ids[used], True), (keys[used], False), (place[doc], False), (pos.astype(np.uint32), False)])


def read_block(raw: bytes) -> tuple[np.ndarray, ...]:
    labels, ids, keys, doc, pos = unpack(raw, [(np.uint64, True), (np.int64, True), (np.int64, False), (np.uint32, False), (np.uint32, False)])
    return labels, ids[doc], keys[doc], pos


def leaders(labels: np.ndarray) -> np.ndarray:
    """For each of the sorted labels, where its deep node begins."""
    head = np.concatenate(([True], labels[1:] != labels[:-1]))
    return np.flatnonzero(head)[np.cumsum(head) - 1]


def _stretches(keys: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    if not len(keys):
        return []
    at = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(at[:-1], at[1:], strict=True))


#: id, key and position of a repeat, then of its first occurrence (none if the repeat is already confirmed)
_PAIR = [(np.int64, True), (np.int64, True), (np.int32, True), (np.int64, True), (np.int64, True), (np.int32, True)]


def write_pairs(columns: tuple[np.ndarray, ...], buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket of rows, block of pairs), one block a bucket."""
    where = (mix(columns[0].astype(np.uint64) + mix(columns[1].astype(np.uint64))) >> _U(33)).astype(np.int64) % buckets
    order = np.lexsort((columns[2], columns[1], columns[0], where))
    where, columns = where[order], tuple(c[order] for c in columns)
    for a, b in _stretches(where):
        yield int(where[a]), pack([(c[a:b].astype(kind), rising) for c, (kind, rising) in zip(columns, _PAIR, strict=False)] + [(np.empty(0, kind), rising) for kind, rising in _PAIR[len(columns) :]])


def merge_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Maximal repeats of the rows of a bucket: n windows in a row whose first occurrences are in a row, too."""
    parts = []
    for raw in pdf["block"]:
        cols = unpack(raw, _PAIR)
        known = len(cols[3]) < len(cols[0])
        parts.append([*cols[:3], np.full(len(cols[0]), known), *(np.zeros(len(cols[0]), c.dtype) if known else c for c in cols[3:])])
    i, key, pos, known, l_id, l_key, l_pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, l_pos - pos, l_key, l_id, known, key, i))
    order = np.concatenate((order[~known[order]], np.flatnonzero(known)[np.lexsort((pos[known], key[known], i[known]))]))
    i, key, pos, known, l_id, l_key, l_pos = (x[order] for x in (i, key, pos, known, l_id, l_key, l_pos))
    goes_on = (i[1:] == i[:-1]) & (key[1:] == key[:-1]) & (pos[1:] - pos[:-1] <= 1) & (pos[1:] >= pos[:-1]) & (known[1:] == known[:-1])
    goes_on &= known[1:] | ((l_id[1:] == l_id[:-1]) & (l_key[1:] == l_key[:-1]) & (l_pos[1:] - pos[1:] == l_pos[:-1] - pos[:-1]))
    head = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    last = np.concatenate((head[1:], [len(i)])) - 1
    return pd.DataFrame({"id": i[head], "key": key[head], "pos": pos[head].astype(np.int64), "n": (pos[last] - pos[head] + 1).astype(np.int64), "known": known[head], "l_id": l_id[head], "l_key": l_key[head], "l_pos": l_pos[head].astype(np.int64)})


def with_key(docs: DataFrame, id_col: Column, text: Column, key: str) -> DataFrame:
    """``docs`` with a column ``key`` that tells rows of one id with different texts apart; 0 where the id comes once."""
    several = cut(docs.select(id_col.alias(f"{key}_i")).where(F.col(f"{key}_i").isNotNull()).groupBy(f"{key}_i").count().where("count > 1").drop("count"))
    n, zero = several.count(), F.lit(0).cast("long")
    if not n:
        return docs.withColumn(key, zero)
    if n > BROADCAST_ROWS:
        return docs.withColumn(key, F.xxhash64(id_col, text))
    own = docs.join(F.broadcast(several), id_col == F.col(f"{key}_i"), "left")
    return own.withColumn(key, F.when(F.col(f"{key}_i").isNull(), zero).otherwise(F.xxhash64(id_col, text))).drop(f"{key}_i")


def keyed(docs: DataFrame) -> DataFrame:
    """id, key, text; a null text is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_key(rows, F.col("id"), F.col("text"), "key").select("id", "key", "text")


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(ids, keys, texts) of distinct rows in order of id, a slice at a time."""
    claim_words()
    ids, keys = (np.asarray(batch.column(i).to_numpy()) for i in (0, 1))
    order = np.lexsort((keys, ids))
    order = order[np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])))] if len(order) else order
    texts = batch.column(2).cast(pa.large_binary()).take(pa.array(order)).to_pylist()
    for own, some in slices(order.tolist(), texts, BATCH_BYTES):
        yield ids[own], keys[own], some


def repeats(text: DataFrame, window: int, group: int) -> DataFrame:
    """Maximal repeats: ``n`` windows from ``pos`` on come from ``l_pos`` on in row (l_id, l_key), or are known to repeat."""
    codes = arrow("code long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CODE_BITS, np.int64)
        for batch in batches:
            for _, _, texts in _batches(batch):
                words = Words(texts)
                pair, doc, pos = words.grams(2)
                full = pos <= (np.diff(words.bounds) - window)[doc]
                total += np.bincount((pair[full] >> _U(64 - CODE_BITS)).astype(np.int64), minlength=len(total))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], schema=codes)

    counts = np.zeros(1 << CODE_BITS, np.int64)
    for r in text.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # 4096 rows at most
        counts[r["code"]] = r["n"]
    base, bits = prefix_groups(counts, group)
    n_groups = int(base.max() + (1 << int(bits[base.argmax()]))) if counts.any() else 1
    form = arrow(BLOCKS)

    def send(words: Words, ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        labels, doc, pos = suffixes(words, window)
        order = np.argsort(labels, kind="stable")  # equal ones stay in order of id and position
        labels, doc, pos = labels[order], doc[order], pos[order]
        first = leaders(labels) if len(labels) else labels.astype(np.int64)
        at = words.bounds[:-1][doc] + pos
        settled = np.flatnonzero(ids[doc] > ids[doc[first]])
        same = np.ones(len(settled), bool)
        for k in range(window):
            same &= words.index[at[settled] + k] == words.index[at[first[settled]] + k]
        settled = settled[same]
        go = np.ones(len(labels), bool)
        go[settled] = False
        code = (labels >> _U(REST_BITS)).astype(np.int64)
        tail = (labels & _U((1 << REST_BITS) - 1)) >> (_U(REST_BITS) - bits[code].astype(np.uint64))
        grp = (base[code] + tail.astype(np.int64))[go]
        labels, own, pos_go = labels[go], doc[go], pos[go]
        out: list[tuple[int, bytes]] = []
        for a, b in _stretches(grp):
            out.append((int(grp[a]), write_block(labels[a:b], ids, keys, own[a:b], pos_go[a:b])))
        if len(settled):
            out += [(-1 - bucket, block) for bucket, block in write_pairs((ids[doc[settled]], keys[doc[settled]], pos[settled]), n_groups)]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], schema=form)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, keys, texts in _batches(batch):
                yield send(Words(texts), ids, keys)

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        claim("trees", lambda: None)  # the words that the worker remembers are not needed here
        if pdf["grp"].iloc[0] < 0:
            return pd.DataFrame({"grp": -1 - pdf["grp"], "block": pdf["block"]})
        labels, ids, keys, pos = (np.concatenate(x) for x in zip(*map(read_block, pdf.pop("block")), strict=True))
        order = np.argsort(labels, kind="stable")
        same = labels[order][1:] == labels[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]  # leaves that are alone go first
        labels, ids, keys, pos = labels[order], ids[order], keys[order], pos[order]
        order = np.lexsort((pos, keys, ids, labels))
        labels, ids, keys, pos = labels[order], ids[order], keys[order], pos[order]
        if not len(labels):
            return pd.DataFrame({"grp": [], "block": []})
        first = leaders(labels)
        head = np.flatnonzero(first == np.arange(len(first)))
        several = np.repeat(np.maximum.reduceat(ids, head) > ids[head], np.diff(np.append(head, len(ids))))
        dup = np.flatnonzero(several & (first != np.arange(len(first))))  # also the leader's other places, in case its label is one by chance
        head = first[dup]
        return pd.DataFrame(list(write_pairs((ids[dup], keys[dup], pos[dup], ids[head], keys[head], pos[head]), n_groups)), columns=["grp", "block"])

    parts = min(n_groups, PARTITIONS)
    found = text.mapInArrow(split, BLOCKS).repartition(parts, "grp").groupBy("grp").applyInPandas(tree, BLOCKS)
    return found.groupBy("grp").applyInPandas(merge_pairs, RUNS)


def segment_digests(text: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(id, key, pos, n, digest) of distinct wanted (id, key, pos, n): the words from pos to the end of window pos + n - 1."""
    form = arrow(DIGESTS)
    asked = wanted.distinct().groupBy(F.col("id").alias("w_id"), F.col("key").alias("w_key")).agg(F.collect_list(F.struct("pos", "n")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, key, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().split()
                digest = [hashlib.blake2b(b" ".join(words[a["pos"] : a["pos"] + a["n"] + window - 1]), digest_size=16).digest() for a in at]
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([i] * n, [key] * n, [a["pos"] for a in at], [a["n"] for a in at], digest), form, strict=True)], schema=form)

    asked, rows = cut(asked), text
    if asked.count() <= BROADCAST_ROWS:  # only the texts of these rows are shuffled
        rows = text.join(F.broadcast(asked.select(F.col("w_id").alias("id")).distinct()), "id", "left_semi").select("id", "key", "text")
    both = rows.join(asked, (F.col("id") == F.col("w_id")) & (F.col("key") == F.col("w_key")))
    return both.select("id", "key", "text", "at").mapInArrow(run, DIGESTS).dropDuplicates(["id", "key", "pos", "n"])


def confirmed(text: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(id, key, pos, n) of the repeats whose words come in a row with a smaller id."""
    guess = found.where("NOT known")
    names = ["id", "key", "pos", "n"]
    first = [F.col(f"l_{c}").alias(c) for c in names[:3]]
    digests = cut(segment_digests(text, guess.select(*names).union(guess.select(*first, "n")), window))
    theirs = digests.select(*(F.col(c).alias(f"l_{c}") for c in names[:3]), "n", F.col("digest").alias("l_digest"))
    if digests.count() <= BROADCAST_ROWS // 4:
        theirs = F.broadcast(theirs)
    judged = cut(guess.join(digests, names).join(theirs, ["l_id", "l_key", "l_pos", "n"]).withColumn("ok", F.col("digest") == F.col("l_digest")).drop("digest", "l_digest"))
    right = found.where("known").select(*names).union(judged.where("ok AND id > l_id").select(*names))
    if judged.where("NOT ok").isEmpty():
        return right
    judged = judged.join(judged.where("NOT ok").select("l_id", "l_key").distinct(), ["l_id", "l_key"], "left_semi")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("step")  # windows with equal labels by chance
    each = judged.select("*", step).select("id", "key", (F.col("pos") + F.col("step")).alias("pos"), "l_id", "l_key", (F.col("l_pos") + F.col("step")).alias("l_pos"), "ok")
    doubtful = each.where("NOT ok").select("l_id", "l_key", "l_pos").distinct()
    members = cut(each.join(doubtful, ["l_id", "l_key", "l_pos"], "left_semi").select("id", "key", "pos", "l_id", "l_key", "l_pos"))
    members = members.union(doubtful.select(F.col("l_id"), F.col("l_key"), F.col("l_pos"), "l_id", "l_key", "l_pos")).withColumn("n", F.lit(1).cast("long")).distinct()
    told = cut(members.join(segment_digests(text, members.select(*names), window), names))
    least = told.groupBy("l_id", "l_key", "l_pos", "digest").agg(F.min("id").alias("least"))
    return right.union(told.join(least, ["l_id", "l_key", "l_pos", "digest"]).where("id > least").select(*names))


def marks(text: DataFrame, window: int = 13, group: int = GROUP) -> DataFrame:
    """(id, key, spans) from rows (id, key, text): pos and n of the runs of windows that come in a row with a smaller id."""
    text = text.where("id is not null")
    found = cut(repeats(text, window, group))
    return confirmed(text, found, window).groupBy("id", "key").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))


def keep_words(text: bytes, spans: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """(words, removed words, kept words joined by one space)."""
    words = text.split()
    n = len(words)
    if not spans:
        return n, 0, b" ".join(words)
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[s["pos"]] += 1
        edge[s["pos"] + s["n"] - 1 + window] -= 1
    gone = np.cumsum(edge)[:n] > 0
    return n, int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone)])


def with_spans(docs: DataFrame, found: DataFrame, id_col: Column, key: str, spans: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows with their spans, the rest if apart); ``docs`` has a column ``key`` from ``with_key``."""
    own = found.select(F.col("id").alias(f"{key}_i"), F.col("key").alias(f"{key}_k"), F.col("spans").alias(spans))
    both = (F.col(key) == F.col(f"{key}_k")) & (id_col == F.col(f"{key}_i"))
    if found.count() > BROADCAST_ROWS:
        return docs.join(own, both, "left").drop(f"{key}_i", f"{key}_k"), None
    ids = F.broadcast(found.select(F.col("id").alias(f"{key}_i")).distinct())
    same = id_col == F.col(f"{key}_i")
    return docs.join(ids, same, "left_semi").join(own, both, "left").drop(f"{key}_i", f"{key}_k"), docs.join(ids, same, "left_anti")


def dedupe_substrings(docs: DataFrame, window: int = 13, group: int = GROUP) -> DataFrame:
    """id, n_words, n_removed, kept: each text without the words of repeats of a smaller document."""
    rows = keyed(docs)
    found = cut(marks(rows, window, group))
    form = arrow(KEPT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts, spans = some.column(1).cast(pa.large_binary()).to_pylist(), some.column(2).to_pylist()
                out = [keep_words(t or b"", s, window) for t, s in zip(texts, spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()).cast(pa.string())], schema=form
                )

    marked, rest = with_spans(rows, found, F.col("id"), "key", "spans")
    out = marked.select("id", "text", "spans").mapInArrow(run, KEPT)
    return out if rest is None else out.union(rest.select("id", "text", F.lit(None).cast("array<struct<pos:long,n:long>>").alias("spans")).mapInArrow(run, KEPT))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name


def dedupe_texts(docs: DataFrame, window: int = 13, group: int = GROUP) -> DataFrame:
    """The rows and columns of ``docs``; texts that lose words are their kept words joined by one space."""
    names, key, spans = docs.columns, fresh(docs, "row_key"), fresh(docs, "row_spans")
    text = next(f for f in docs.schema if f.name == "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            new = []
            for t, s in zip(batch.column(i).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                kept = keep_words(t.encode(), s, window) if t and s else (0, 0, b"")
                new.append(kept[2].decode() if kept[1] else t)
            out = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            yield out.select(names)

    small_batches(docs.sparkSession)
    own = docs if isinstance(text.dataType, T.StringType) else docs.withColumn("text", F.col("text").cast("string"))
    own = with_key(own, F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), key)
    found = cut(marks(own.select(F.col("doc_id").cast("long").alias("id"), F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")), window, group))
    marked, rest = with_spans(own, found, F.col("doc_id").cast("long"), key, spans)
    schema = own.drop(key).schema
    out = marked.drop(key).mapInArrow(run, schema)
    return out if rest is None else out.union(rest.drop(key).select(*names))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """13-word windows of all documents."""
    kept = dedupe_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13)
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws)-11, 1))) AS p FROM w),
g AS (SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS k FROM s),
m AS (SELECT k, min(doc_id) AS d FROM g GROUP BY k),
x AS (SELECT DISTINCT g.doc_id, unnest(range(g.p, g.p+13)) AS p FROM g JOIN m ON g.k=m.k AND g.doc_id > m.d),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws)+1)) AS p FROM w),
r AS (SELECT a.doc_id, count(*) AS n, count(x.p) AS gone, coalesce(string_agg(CASE WHEN x.p IS NULL THEN word END, ' ' ORDER BY a.p),'') AS kept
  FROM a LEFT JOIN x ON a.doc_id=x.doc_id AND a.p=x.p GROUP BY a.doc_id)
SELECT w.doc_id, coalesce(n,0)::BIGINT AS n_words, coalesce(gone,0)::BIGINT AS n_removed, sha256(coalesce(kept,'')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""
