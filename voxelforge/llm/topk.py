"""Exact top-k inner products by distributed histogram selection.

Scores are integers.  Every pass scores all rows against a block of queries and adds up, per query, a
histogram over the interval that still holds the k-th largest score; the bin of the k-th value becomes
the next interval.  A task adds up all its rows and then reports, per query, its bins from the top until
they hold k rows, which is all that can matter.  When an interval is one score wide, the rows above it,
and of the rows at it the smallest ids that are still needed, are the answer.  The same selection runs
whatever the ties: of a piece of 2048 rows at most k at the k-th value are reported for a query.

Queries are taken in blocks of bounded size, and only a block is ever broadcast.  A block of 32,768 queries
of 64 components asks for 4 million operations a row, so scoring, not reading the table again for every
block, is what the work consists of; the hits of the blocks are written to the shared folder.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, neither do
null ids; vectors of another length than the query's are no candidates; a query never finds its own id,
so rows that repeat an id do not find each other; of vectors that share a query's id the smallest asks.
Repeated candidates each take a rank.  Products are exact; one of 2**62 or more raises, as
no ranking by a long could be right.
An empty table gives an empty result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow, shared

BINS = 256
#: Queries of one block at most, and bytes of their vectors at most (the broadcast side: 8 bytes a component).
BLOCK_QUERIES, BLOCK_BYTES = 32_768, 64_000_000
HIST = "q long, bin long, n long"
HITS = "q long, vec_id long, score long"
_TOP = 2**62 - 1
#: Products below it are under 2**62 whatever the rounding of their doubles; intervals of scores then fit a long.
LARGEST = 2.0**62 * (1 - 2**-30)


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, v array<double>) with v = floor(scale * x); only valid vectors."""
    x = F.transform(F.col(vec_col), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    ok = F.forall(F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ok).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) by vector length."""
    ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False))
    lists = batch.column(1)
    lens = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.concatenate(([0], np.cumsum(lens)))
    for n in np.unique(lens):
        own = np.flatnonzero(lens == n)
        yield ids[own], flat[(at[own][:, None] + np.arange(n))]


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products (queries x rows): doubles are exact below 2**53, beyond it whole numbers modulo 2**64 are.

    A larger product raises: a ranking of clipped scores would be wrong.
    """
    near = q @ v.T
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return near.astype(np.int64)
    if max(np.abs(q).max(initial=0), np.abs(v).max(initial=0)) >= 2**63 or not (np.abs(near) < LARGEST).all():
        raise OverflowError("an inner product exceeds 62 bits; choose a smaller scale")
    return q.astype(np.int64) @ v.astype(np.int64).T


def _scored(batches: Iterator[pa.RecordBatch], by_len: dict) -> Iterator[tuple]:
    """(places of the queries, their ids, scores, whether the row is another one, row ids), in pieces."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            for ids, v in _blocks(batch.slice(i, 2048)):
                at, qid, q = by_len.get(v.shape[1], ((), (), ()))
                for j in range(0, len(qid), 256):
                    yield at[j : j + 256], qid[j : j + 256], _scores(q[j : j + 256], v), ids[None, :] != qid[j : j + 256, None], ids


def histograms(rows: DataFrame, block, state: np.ndarray, k: int) -> DataFrame:
    """(q, bin, n): scores of all rows in the bins of each query's interval; BINS is what lies above it."""
    form = arrow(HIST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.empty(len(state), np.int64)
        for at, qid, _ in block.value.values():
            names[at] = qid
        total = np.zeros((len(state), BINS + 1), np.int32)
        for at, qid, s, ok, _ in _scored(batches, block.value):
            lo, width = state[at, 0:1], state[at, 1:2]
            bins = np.minimum((np.maximum(s, lo) - lo) // width, BINS)  # scores below the interval cannot be the k-th
            key = (np.arange(len(qid))[:, None] * (BINS + 1) + bins)[ok & (s >= lo)]
            total[at] += np.bincount(key, minlength=len(qid) * (BINS + 1)).reshape(len(qid), BINS + 1).astype(np.int32)
        for i in range(0, len(total), 4096):
            count = total[i : i + 4096].astype(np.int64)
            above = np.cumsum(count[:, ::-1], 1)[:, ::-1] - count
            r, c = np.nonzero((count > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(names[i + r]), pa.array(c), pa.array(count[r, c])], schema=form)

    return rows.mapInArrow(run, HIST)


def taken(rows: DataFrame, block, state: np.ndarray) -> DataFrame:
    """(q, vec_id, score): rows above each query's k-th score, and of those at it the smallest ids of a batch."""
    form = arrow(HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, qid, s, ok, ids in _scored(batches, block.value):
            kth, need = state[at, 0], state[at, 1]
            r, c = np.nonzero(ok & (s > kth[:, None]))
            order = np.argsort(ids, kind="stable")
            tie = (ok & (s == kth[:, None]))[:, order]
            tr, tc = np.nonzero(tie & (np.cumsum(tie, 1) <= need[:, None]))
            if len(r) or len(tr):
                cols = (np.concatenate((qid[r], qid[tr])), np.concatenate((ids[c], ids[order][tc])), np.concatenate((s[r, c], s[:, order][tr, tc])))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=form)

    return rows.mapInArrow(run, HITS)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) for integer vectors (id, v) as ``integer_vectors`` gives them."""
    spark = rows.sparkSession
    total = queries.count()
    peak = rows.select(F.max(F.array_max(F.transform("v", F.abs))).alias("m"), F.max(F.size("v")).alias("d")).first()
    most = min(BLOCK_QUERIES, max(1, BLOCK_BYTES // (8 * (peak["d"] or 1))))
    n_blocks = max(1, -(-2 * total // most)) if total > most // 2 else 1  # about half full, by hash
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    shared(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/topk-{uuid.uuid4().hex}"
    found: DataFrame | None = None
    for b in range(n_blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b) if n_blocks > 1 else queries
        got = [(r["id"], r["v"]) for r in own.toLocalIterator()]
        if not got or peak["m"] is None:
            continue
        by_len, qids = {}, []
        for n in sorted({len(v) for _, v in got}):
            some = [(i, v) for i, v in got if len(v) == n]
            at = np.arange(len(qids), len(qids) + len(some))
            qids += [i for i, _ in some]
            by_len[n] = (at, np.array([i for i, _ in some], np.int64), np.array([v for _, v in some], np.float64))
        block = spark.sparkContext.broadcast(by_len)
        where = {q: i for i, q in enumerate(qids)}
        reach = min(_TOP, int(peak["m"]) ** 2 * int(peak["d"]) + 1)
        low = np.full(len(qids), -reach, object)
        width = np.full(len(qids), 2 * reach // BINS + 1, object)
        above, need = np.zeros(len(qids), np.int64), np.full(len(qids), k, np.int64)
        live = np.ones(len(qids), bool)
        while live.any():
            st = np.stack([np.array([max(-_TOP, int(x)) for x in low], np.int64), np.array([min(_TOP, int(x)) for x in width], np.int64)], 1)
            st[~live] = (_TOP, 1)
            hist = histograms(rows, block, st, k).groupBy("q", "bin").agg(F.sum("n").alias("n"))
            over = Window.partitionBy("q").orderBy(F.desc("bin"))
            cum = hist.withColumn("c", F.sum("n").over(over)).where(F.col("c") - F.col("n") < k)
            last = cum.groupBy("q").agg(F.min_by("bin", "bin").alias("bin"), F.max_by(F.col("c") - F.col("n"), "c").alias("above"), F.max("c").alias("c"))
            seen = set()
            for r in last.collect():
                i = where[r["q"]]
                seen.add(i)
                if r["c"] < k:  # fewer than k candidates: all of them
                    low[i], need[i], live[i] = -_TOP - 1, k, False
                    continue
                if r["bin"] == BINS:
                    raise AssertionError("the k-th score left its interval")
                low[i] += int(r["bin"]) * int(width[i])
                above[i] = r["above"]
                need[i] = k - r["above"]
                if width[i] == 1:
                    live[i] = False
                else:
                    width[i] = width[i] // BINS + 1 if width[i] > BINS else 1
            for i in np.flatnonzero(live):
                if i not in seen:
                    low[i], live[i] = -_TOP - 1, False
        st = np.stack([np.array([max(-_TOP - 1, int(x)) for x in low], np.int64), need], 1)
        found = taken(rows, block, st)
        if n_blocks > 1:
            found.write.parquet(f"{folder}/block={b}")
            block.unpersist()
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = found if n_blocks == 1 else spark.read.schema(HITS).parquet(f"{folder}/block=*")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector."""
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(rows.where("id % 100 = 0"), rows, 10)


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
