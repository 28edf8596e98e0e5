"""Quality rules by distribution divergence.

For every language the documents that carry its label give two reference histograms: character classes,
and the ``COMMON`` most frequent words (in lower case) with one bin for all others, counted by Spark.  A
document's own histograms are compared with each language's by Jensen-Shannon distance; the nearest
language counts.  Texts shorter than ``min_words`` are judged by the base rules alone, which they fail.

Edge cases: null and empty texts have no words and fail the base rules.  Rows are judged one by one, so
repeated rows repeat their result.  Very long texts are read whole.  An empty table gives an empty result.
Rows without a language label take no part in the references but are
judged.  Without any labelled row the divergence rule passes everything.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, arrow, claim_words, cut, slices, small_batches

#: Words of a language that have a bin of their own; all others share one.
COMMON = 128
#: lower, upper, digit, white space, sentence marks, brackets and quotes, symbols, other ASCII, accented (per lead byte C3, C2-C5), other
CLASSES = 10
_CLASS = np.full(256, 7, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:!?", b"()[]{}\"'`-", b"#*$%&|<>@^~=+/\\_")):
    _CLASS[list(_chars)] = _i
_CLASS[0xC2:0xC6], _CLASS[0xC6:256] = 8, 9
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, divergence_chars double, divergence_words double"
REFS = "lang string, class long, word string, n long"
#: Largest Jensen-Shannon distance (0 to 1) that is kept, for character classes and for words.
MAX_CHARS, MAX_WORDS = 0.30, 0.56


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Code points of each class, by text."""
    whole = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    head = (buf & 0xC0) != 0x80  # one byte a code point
    return np.bincount(whole[head] * CLASSES + _CLASS[buf[head]], minlength=len(texts) * CLASSES).reshape(len(texts), CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each row of p from q; empty rows have distance 1."""
    s = p.sum(1, keepdims=True)
    p, q = p / np.maximum(s, 1), q / max(1e-300, q.sum())
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(s[:, 0] > 0, np.sqrt(np.clip(d / 2, 0, 1)), 1.0)


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """lang -> (class counts, place of each common word, counts of these and of the rest), over all labelled documents."""
    form = arrow(REFS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim_words()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            for some, own in slices(langs, texts):
                names = sorted(set(some))
                place = np.array([names.index(x) for x in some])
                chars = np.stack([class_counts(own)[place == i].sum(0) for i in range(len(names))])
                words = Words([t.lower() for t in own])
                both = np.repeat(place, np.diff(words.bounds)) * max(1, len(words.values)) + words.index
                kind, n = np.unique(both, return_counts=True)
                lang, word = np.divmod(kind, max(1, len(words.values)))
                cols = (
                    [names[i] for i in lang.tolist()] + [x for x in names for _ in range(CLASSES)], [None] * len(kind) + list(range(CLASSES)) * len(names),
                    [words.values[i].decode() for i in word.tolist()] + [None] * chars.size, np.concatenate((n, chars.ravel())),
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, form, strict=True)], schema=form)

    counts = docs.where("lang is not null").select("lang", F.col("text").cast("string")).mapInArrow(run, REFS).groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    out = {r["lang"]: (np.zeros(CLASSES), {}, np.zeros(COMMON + 1)) for r in counts.where("word IS NULL").select("lang").distinct().orderBy("lang").collect()}
    for r in counts.where("word IS NULL").collect():  # CLASSES rows a language
        out[r["lang"]][0][r["class"]] = r["n"]
    words = counts.where("word IS NOT NULL")
    for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        out[r["lang"]][2][COMMON] = r["n"]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    for r in words.withColumn("rank", rank).where(F.col("rank") <= COMMON).orderBy("lang", "rank").collect():  # COMMON rows a language
        _, place, n = out[r["lang"]]
        place[r["word"]] = len(place)
        n[place[r["word"]]] = r["n"]
        n[COMMON] -= r["n"]
    return out


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat: int = 50, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS) -> DataFrame:
    """Base counts, their verdict, divergences and the verdict of both, per document."""
    small_batches(docs.sparkSession)
    refs = {k: (c, {w.encode(): i for w, i in place.items()}, n) for k, (c, place, n) in references(docs).items()}
    form = arrow(STATS)

    def judge(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        n = len(texts)
        chars, words = class_counts(texts), Words([t.lower() for t in texts])
        counts = np.diff(words.bounds)
        heads = np.concatenate(([0], np.cumsum((np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) & 0xC0) != 0x80)))
        doc = np.repeat(np.arange(n), counts)
        word_chars = np.bincount(doc, heads[words.ends] - heads[words.starts], minlength=n).astype(np.int64)
        mark = np.concatenate(([0], np.cumsum(_SYMBOL[np.frombuffer(b"".join(texts), np.uint8)])))
        at = np.cumsum([0] + [len(t) for t in texts])
        dup_lines = []
        for t in texts:
            lines = [x for x in t.split(b"\n") if x.strip()]
            dup_lines.append(len(lines) - len(set(lines)))
        as_is = Words(texts)
        gram, g_doc, g_pos = as_is.grams(3)
        order = np.lexsort((gram, g_doc))
        same = (gram[order][1:] == gram[order][:-1]) & (g_doc[order][1:] == g_doc[order][:-1])
        twice = np.zeros(len(gram), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        first = as_is.bounds[:-1][g_doc[twice]] + g_pos[twice]
        covered = np.zeros(len(as_is.hashes), bool)
        for k in range(3):
            covered[first + k] = True
        repeat = np.bincount(doc, covered, minlength=n).astype(np.int64)
        failed = (counts < min_words) | (100 * repeat > max_repeat * counts)
        d_chars, d_words = np.ones(n), np.ones(n)
        score = np.full(n, np.inf)
        for c, place, ref in refs.values():
            a = distance(chars, c)
            bins = np.array([place.get(w, COMMON) for w in words.values], np.int64)
            own = np.bincount(doc * (COMMON + 1) + bins[words.index], minlength=n * (COMMON + 1)) if len(doc) else np.zeros(n * (COMMON + 1))
            b = distance(own.reshape(n, COMMON + 1), ref)
            worst = np.maximum(a / max_chars, b / max_words)
            near = worst < score
            d_chars, d_words, score = np.where(near, a, d_chars), np.where(near, b, d_words), np.where(near, worst, score)
        kept = ~failed & ((score <= 1) | (not refs))
        cols = (ids, counts, word_chars, mark[at[1:]] - mark[at[:-1]], dup_lines, repeat, failed, kept, d_chars, d_words)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, form, strict=True)], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            claim_words()
            for ids, some in slices(batch.column(0).to_pylist(), texts, 2_000_000):
                yield judge(ids, some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, STATS)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, verdicts and distances of all documents."""
    judged = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.withColumns({c: F.round(c, 6) for c in ("divergence_chars", "divergence_words")})


#: Characters that are in each class, in the order of ``CLASSES``, for SQL.
_SQL_CLASSES = (r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^ \t\n\x0B\f\r]", r"[^.,;:!?]", r"[^()\[\]{}\x22\x27`-]", r"[^#*$%&|<>@\^~=+/\\_]", r"[^\x00-\x08\x0E-\x1F\x7F]", r"[^\x{80}-\x{17F}]", r"[\x00-\x{17F}]")
ORACLE = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_transform(string_split(t, chr(10)), lambda x: x) AS ls FROM d),
a AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
g AS (SELECT x.r, x.p, x.word || ' ' || y.word || ' ' || z.word AS k FROM a x JOIN a y ON x.r = y.r AND y.p = x.p + 1 JOIN a z ON x.r = z.r AND z.p = x.p + 2),
h AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p + j) AS n FROM h, range(3) o(j) GROUP BY r),
li AS (SELECT r, line FROM (SELECT r, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
du AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM li GROUP BY r),
wc AS (SELECT r, sum(length(word)) AS n FROM a GROUP BY r),
base AS (SELECT w.r, doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(wc.n, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(du.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN wc USING (r) LEFT JOIN du USING (r) LEFT JOIN rep USING (r)),
cc AS (SELECT r, lang, c.i AS i, length(CASE c.i """
    + " ".join(f"WHEN {i} THEN regexp_replace(t, '{x}', '', 'g')" for i, x in enumerate(_SQL_CLASSES))
    + r""" END)::DOUBLE AS n FROM d, range(10) c(i)),
low AS (SELECT r, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM a),
vc AS (SELECT lang, word, count(*) AS n FROM low JOIN d USING (r) WHERE lang IS NOT NULL GROUP BY 1, 2),
com AS (SELECT lang, word, n::DOUBLE AS n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM vc) WHERE k <= 128),
al AS (SELECT lang, sum(n)::DOUBLE AS n FROM vc GROUP BY 1),
langs AS (SELECT DISTINCT lang FROM d WHERE lang IS NOT NULL),
qc AS (SELECT lang, i, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT lang, i, sum(n) AS n FROM cc WHERE lang IS NOT NULL GROUP BY 1, 2)),
qw AS (SELECT lang, word, com.n / al.n AS q FROM com JOIN al USING (lang) UNION ALL SELECT lang, NULL, (any_value(al.n) - sum(com.n)) / any_value(al.n) FROM com JOIN al USING (lang) GROUP BY lang),
hits AS (SELECT r, com.lang, word, count(*)::DOUBLE AS n FROM low JOIN com USING (word) GROUP BY 1, 2, 3),
known AS (SELECT r, lang, sum(n) AS n FROM hits GROUP BY 1, 2),
pw AS (SELECT b.r, q.lang, q.q, CASE WHEN q.word IS NULL THEN b.n_words - coalesce(k.n, 0) ELSE coalesce(h.n, 0) END / b.n_words AS p
  FROM base b CROSS JOIN qw q LEFT JOIN hits h ON h.r = b.r AND h.lang = q.lang AND h.word = q.word LEFT JOIN known k ON k.r = b.r AND k.lang = q.lang WHERE b.n_words > 0),
pc AS (SELECT c.r, q.lang, q.q, c.n / s.n AS p FROM cc c JOIN (SELECT r, sum(n) AS n FROM cc GROUP BY r) s ON s.r = c.r AND s.n > 0 JOIN qc q ON q.i = c.i),
js AS (SELECT kind, r, lang, sqrt(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0), 1)) AS v
  FROM (SELECT 'c' AS kind, r, lang, p, q FROM pc UNION ALL SELECT 'w', r, lang, p, q FROM pw) GROUP BY 1, 2, 3),
both_ AS (SELECT b.r, l.lang, coalesce(c.v, 1) AS c, coalesce(w.v, 1) AS w FROM base b CROSS JOIN langs l LEFT JOIN js c ON c.kind = 'c' AND c.r = b.r AND c.lang = l.lang LEFT JOIN js w ON w.kind = 'w' AND w.r = b.r AND w.lang = l.lang),
near AS (SELECT r, min(greatest(c / 0.30::DOUBLE, w / 0.56::DOUBLE)) AS s, arg_min(c, (greatest(c / 0.30::DOUBLE, w / 0.56::DOUBLE), lang)) AS c, arg_min(w, (greatest(c / 0.30::DOUBLE, w / 0.56::DOUBLE), lang)) AS w FROM both_ GROUP BY r),
done AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base LEFT JOIN near USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(s <= 1, TRUE) AS kept,
  round(coalesce(c, 1), 6) AS divergence_chars, round(coalesce(w, 1), 6) AS divergence_words FROM done
"""
)
