"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Counts of all words become one table.  Words of one length are points: how often each letter comes in the
first half and in the second.  One replaced letter lowers one coordinate and raises another, one inserted
letter raises a single one (the longer word is halved behind the same letter, once with the letter counted
in front of it and once behind).  K-d trees, one for every length, are searched with words of that length
and of the next; boxes further away than this are pruned, and what is left is verified letter by letter.

The upper part of the trees deals words to Spark partitions: its planes come from a bounded sample of the
words (``SAMPLE``), which decides about balance only.  A word lies in one leaf; as a query it visits the
leaves whose boxes it can reach.  Inside a task the tree of the leaf's own points goes on.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty id.  Rows that repeat count
again.  Ties of the most frequent near word go to the smallest in code-point order.  Words are not limited in
length.  Words with the same letters in both halves share a leaf; none of them are near each other, but
their number bounds the work of a task from below.  Extra columns are ignored.  An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, distinct, id_text, texts_of

#: Shortest word, and fewest occurrences of one.
MIN_LETTERS, MIN_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Words that a leaf of the upper trees should hold, and words from which their planes are drawn, each at most so long.
LEAF, SAMPLE, SAMPLE_LETTERS = 8000, 65_536, 64
#: Points of a leaf inside a task; queries and pairs handled at once.
POINTS, BLOCK = 32, 8192
LETTERS = 90  # a to z, U+00C0 to U+00FF
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PLACE = np.zeros(256, np.uint8)
_PLACE[0x61:0x7B] = np.arange(26)
_PLACE[0x80:0xC0] = 26 + np.arange(64)
SAME, LONGER = 1, 2
ROUTED = "length int, leaf int, role int, word string, n long"
NEAR = "word string, n_near long, best_n long, best string"


def letter_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text of every run of at least MIN_LETTERS letters, its number among the distinct ones, these in lower case)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    letter = _LETTER[buf]
    lead = np.flatnonzero(buf == 0xC3)
    letter[lead] = letter[lead + 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2]
    leads = np.concatenate(([0], np.cumsum(buf == 0xC3)))
    long = (end - start) - (leads[end] - leads[start]) >= MIN_LETTERS
    start, end = start[long], end[long]
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)))
    bytes_at = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    index, values = distinct(_LOWER[buf[bytes_at]], at)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return doc, index, values


def misspelt(word: bytes, h: int) -> bytes:
    """The word without the letter that its checksum names."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = 31) -> DataFrame:
    """(word, n) of all words that come MIN_COUNT times; one letter goes where ``drop_every`` divides the checksum of id and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = zlib.crc32
        for batch in batches:
            for ids, texts in texts_of(batch):
                doc, index, values = letter_runs(texts)
                heads = [crc(f"{'' if i is None else i}:".encode()) for i in ids]
                both, n = np.unique(doc * max(1, len(values)) + index, return_counts=True)
                at, word = np.divmod(both, max(1, len(values)))
                sums = np.array([crc(values[w], heads[d]) for d, w in zip(at.tolist(), word.tolist(), strict=True)], np.int64)
                hit = sums % drop_every == 0
                whole = np.bincount(word[~hit], n[~hit], len(values)).astype(np.int64)
                made = [misspelt(values[w], h) for w, h in zip(word[hit].tolist(), sums[hit].tolist(), strict=True)]
                kept = np.flatnonzero(whole)
                names = [values[i] for i in kept.tolist()] + made
                letters = np.array([len(w) - w.count(b"\xc3") for w in names], np.int64) >= MIN_LETTERS
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()).filter(pa.array(letters)).cast(pa.string()), pa.array(np.concatenate((whole[kept], n[hit]))[letters], pa.int64())], ["word", "n"]
                )

    counts = id_text(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def codes(words: list[bytes], length: int) -> np.ndarray:
    """Letters by number: a row per word of this length."""
    buf = np.frombuffer(b"".join(words), np.uint8)
    return _PLACE[buf[buf != 0xC3]].reshape(-1, length)


class Points:
    """Letter counts of both halves over the letters of some words; all others share a coordinate."""

    def __init__(self, letters: np.ndarray):
        used = np.flatnonzero(np.bincount(letters.ravel(), minlength=LETTERS))
        self.place = np.full(LETTERS, len(used), np.int64)
        self.place[used] = np.arange(len(used))
        self.width = len(used) + 1

    def of(self, letters: np.ndarray, half: int) -> np.ndarray:
        n, length = letters.shape
        kind = np.int8 if length < 128 else np.int32
        at = self.place[letters] + np.where(np.arange(length) < half, 0, self.width) + np.arange(n)[:, None] * (2 * self.width)
        return np.bincount(at.ravel(), minlength=n * 2 * self.width).reshape(n, 2 * self.width).astype(kind)


class Unary:
    """Counts as bits, one for each letter up to ``most``: what one count exceeds another by is a number of bits."""

    def __init__(self, most: np.ndarray):
        self.axis = np.repeat(np.arange(len(most)), most)
        self.level = np.arange(len(self.axis)) - np.repeat(np.cumsum(most) - most, most)

    def of(self, counts: np.ndarray) -> np.ndarray:
        bits = np.packbits(counts[:, self.axis] > self.level, axis=1)
        wide = np.zeros((len(counts), max(8, -(-bits.shape[1] // 8) * 8)), np.uint8)
        wide[:, : bits.shape[1]] = bits
        return wide.view(np.uint64)


def excess(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters of a beyond those of b."""
    return np.bitwise_count(a & ~b).sum(-1, dtype=np.int32)


class KdTree:
    """Boxes of points, halved along the coordinate that spreads most.

    ``tight`` boxes are those of the points; else they are bounded by the planes alone and hold any point.
    A node is (low, high, coordinate, value, left, right) or, for a leaf, (low, high, leaf number, points),
    low and high coded by ``code``.
    """

    def __init__(self, points: np.ndarray, leaves: int, tight: bool, most: np.ndarray | None = None):
        self.tight, self.leaves = tight, 0
        top = points.max(0, initial=0)
        self.code = Unary(top if most is None else np.maximum(top, most))
        low, high = np.zeros(points.shape[1], points.dtype), np.full(points.shape[1], np.iinfo(points.dtype).max, points.dtype)
        self.root = self._node(points, np.arange(len(points)), leaves, low, high)

    def _node(self, points: np.ndarray, own: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> tuple:
        some = points[own]
        if self.tight and len(own):
            low, high = some.min(0), some.max(0)
        box = tuple(self.code.of(np.stack((low, high))))
        if leaves > 1 and len(own) > 1:
            spread = some.astype(np.float32).var(0)
            axis = int(spread.argmax())
            if spread[axis] > 0:
                line = some[:, axis]
                left = leaves // 2
                value = int(np.partition(line, len(line) * left // leaves)[len(line) * left // leaves])
                value = min(max(value, int(line.min())), int(line.max()) - 1)
                below = line <= value
                upper, lower = high.copy(), low.copy()
                upper[axis], lower[axis] = value, value + 1
                share = min(max(1, round(leaves * below.mean())), leaves - 1)
                return *box, axis, value, self._node(points, own[below], share, low, upper), self._node(points, own[~below], leaves - share, lower, high)
        self.leaves += 1
        return *box, self.leaves - 1, own

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf in which each point lies."""
        out, todo = np.zeros(len(points), np.int64), [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if len(node) == 4:
                out[own] = node[2]
            else:
                below = points[own, node[2]] <= node[3]
                todo += [(node[4], own[below]), (node[5], own[~below])]
        return out

    def reached(self, queries: np.ndarray, less: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, its points, queries) wherever a coded query can be a point of the box with one letter more and ``less`` letters less."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, own = todo.pop()
            q = queries[own]
            own = own[(excess(q, node[1]) <= 1) & (excess(node[0], q) <= less)]
            if not len(own):
                continue
            if len(node) == 4:
                yield node[2], node[3], own
            else:
                todo += [(node[4], own), (node[5], own)]


def search(points: np.ndarray, queries: np.ndarray, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (query, point) of all pairs of counts that differ by one letter more and ``less`` letters less."""
    tree = KdTree(points, max(1, len(points) // POINTS), True, queries.max(0, initial=0))
    points, queries = tree.code.of(points), tree.code.of(queries)
    for first in range(0, len(queries), BLOCK):
        for _, own, some in tree.reached(queries[first : first + BLOCK], less):
            for a in range(0, len(own), 4 * POINTS):
                for b in range(0, len(some), BLOCK // POINTS):
                    near, asked = own[a : a + 4 * POINTS], first + some[b : b + BLOCK // POINTS]
                    q, p = np.nonzero(excess(queries[asked][:, None], points[near]) == 1)  # both have as many letters as their lengths say
                    if len(q):
                        yield asked[q], near[p]


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(1) == 1


def common_ends(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters that each pair has in common at its beginning and at its end."""
    n = short.shape[1]
    head, tail = short != long[:, :n], (short != long[:, 1:])[:, ::-1]
    return tuple(np.where(x.any(1), x.argmax(1), n) for x in (head, tail))


def near_in_leaf(length: int, data: list[bytes], same: list[bytes], longer: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of near words, each of ``data`` and one of data + same + longer: their numbers in this list."""
    own, others, more = codes(data, length), codes(same, length), codes(longer, length + 1)
    kinds, half = Points(own), length // 2
    points = kinds.of(own, half)
    words, found = data + same, []
    every = np.concatenate((own, others))
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    for q, p in search(points, kinds.of(every, half), 1):
        some = order[q] > order[p]  # each pair from its larger word
        q, p = q[some], p[some]
        good = one_replaced(every[q], own[p])
        found.append((q[good], p[good]))
    for extra in (0, 1):  # the letter is behind the middle, or before it
        for q, p in search(points, kinds.of(more, half + extra), 0):
            head, tail = common_ends(own[p], more[q])
            good = (head + tail >= length) & ((head < half) if extra else (head >= half))
            found.append((q[good] + len(words), p[good]))
    return tuple(np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in range(2))


def planes(vocabulary: DataFrame) -> dict[int, tuple[Points, KdTree]]:
    """length -> upper tree, from at most about SAMPLE words of at most SAMPLE_LETTERS letters."""
    sizes = {r["length"]: r["n"] for r in vocabulary.where(F.length("word") <= SAMPLE_LETTERS).groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    share = min(1 << 20, (SAMPLE << 20) // total)
    picked = vocabulary.where((F.length("word") <= SAMPLE_LETTERS) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)).select(F.length("word").alias("length"), "word").collect()
    out, words = {}, {}
    for r in picked:
        words.setdefault(r["length"], []).append(r["word"].encode())
    for length, n in sizes.items():
        if n > LEAF and length in words:
            letters = codes(sorted(words[length]), length)
            kinds = Points(letters)
            out[length] = kinds, KdTree(kinds.of(letters, length // 2), min(-(-n // LEAF), max(1, len(letters) // 8)), tight=False)
    return out


def route(vocabulary: DataFrame, trees: dict[int, tuple[Points, KdTree]]) -> DataFrame:
    """Every word to its leaf (role 0) and, as a query, to the leaves that it reaches in the trees of its length and the one below."""

    def targets(letters: np.ndarray, length: int, role: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, leaf) pairs of queries, each once."""
        if length not in trees:
            yield np.arange(len(letters)), np.zeros(len(letters), np.int64)
            return
        kinds, tree = trees[length]
        got = [np.empty(0, np.int64)]
        for extra in (0,) if role == SAME else (0, 1):
            for leaf, _, own in tree.reached(tree.code.of(kinds.of(letters, length // 2 + extra)), int(role == SAME)):
                got.append(own * tree.leaves + leaf)
        both = np.unique(np.concatenate(got))
        yield both // tree.leaves, both % tree.leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy()
            for length in np.unique(size).tolist():
                b = batch.filter(pa.array(size == length))
                letters = codes(b.column("word").cast(pa.binary()).to_pylist(), length)
                home = np.zeros(len(letters), np.int64)
                if length in trees:
                    kinds, tree = trees[length]
                    home = tree.leaf_of(kinds.of(letters, length // 2))
                out = [(length, 0, np.arange(len(letters)), home)]
                for at, role in ((length, SAME), (length - 1, LONGER)):
                    for word, leaf in targets(letters, at, role):
                        away = np.ones(len(word), bool) if role == LONGER else leaf != home[word]
                        out.append((at, role, word[away], leaf[away]))
                for at, role, word, leaf in out:
                    if len(word) and at >= MIN_LETTERS:
                        some = pa.array(word)
                        full = lambda v, n=len(word): pa.array(np.full(n, v, np.int32))
                        yield pa.RecordBatch.from_arrays([full(at), pa.array(leaf, pa.int32()), full(role), b.column("word").take(some), b.column("n").take(some)], ["length", "leaf", "role", "word", "n"])

    return vocabulary.select(F.length("word").alias("length"), "word", "n").mapInArrow(run, ROUTED)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: how many words are one edit from each, and the most frequent; words without one are absent."""
    trees = planes(vocabulary)

    def run(table: pa.Table) -> pa.Table:
        length, role = table.column("length")[0].as_py(), table.column("role").to_numpy()
        order = np.argsort(role, kind="stable")
        table = table.take(pa.array(order))
        words, n = table.column("word").combine_chunks().cast(pa.binary()).to_pylist(), table.column("n").to_numpy()
        a, b = np.searchsorted(role[order], (SAME, LONGER))
        q, p = near_in_leaf(length, words[:a], words[a:b], words[b:]) if a else (np.empty(0, np.int64),) * 2
        one, two = np.concatenate((q, p)), np.concatenate((p, q))
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        first = np.lexsort((place[two], -n[two], one))
        one, two = one[first], two[first]
        new = np.flatnonzero(np.diff(one, prepend=-1))
        count = np.diff(np.append(new, len(one)))
        names = table.column("word").combine_chunks()
        return pa.table([names.take(pa.array(one[new])), pa.array(count, pa.int64()), pa.array(n[two[new]], pa.int64()), names.take(pa.array(two[new]))], ["word", "n_near", "best_n", "best"])

    found = route(vocabulary, trees).groupBy("length", "leaf").applyInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last one.  Every form is RATIO times as frequent, so chains are short."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        following = cut(now.join(up, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")))
        now = following.select("word", "root")
        if following.where("__moved").isEmpty():
            return now


def group_variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table (word, n) of distinct words."""
    vocabulary = cut(vocabulary.select("word", "n"))
    near = near_words(vocabulary)
    known = cut(vocabulary.join(near, "word", "left").withColumn("__far", F.col("best_n") >= RATIO * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("__far"), F.col("best")).alias("form"), F.when(F.col("__far"), F.col("best_n")).alias("form_n"),
    ))
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), runs AS (
  SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL
), coded AS MATERIALIZED (
  SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM runs
), summed AS (
  SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, crc
), v AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS MATERIALIZED (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.size = b.size AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, c.word, c.n FROM v JOIN cuts c ON c.rest = v.word
  UNION SELECT c.word, v.word, v.n FROM v JOIN cuts c ON c.rest = v.word
), best AS (
  SELECT word, count(*) AS n_near, (array_agg(other ORDER BY m DESC, other))[1] AS other, max(m) AS m FROM near GROUP BY word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS last, 1 AS depth FROM f WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL
), ends AS (SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their forms."""
    return group_variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
