"""Approximate nearest neighbours by a permutation index.

Pivots are drawn from a bounded sample. A vector is represented by the order of its
nearest pivots, and posted in the inverted files of those alone, with the place that the
pivot has in its order. A query reads the files of its own nearest pivots, sums the
footrule distance of the two orders (a pivot that a vector isn't posted under counts as
the place after the last), takes the closest share of a block of vectors and reranks it
with the exact inner product. The last step merges the blocks' lists. Every vector is
indexed; only the choice of pivots is sampled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm._store import bound_batches

#: Pivots of the index, vectors they are drawn from, share of a block reranked and its least number.
PIVOTS, SAMPLE, SHARE, LEAST = 256, 4096, 0.07, 400
#: Nearest pivots under which a vector is posted, and files that a query reads.
POSTED, READ = 64, 32
#: Vectors of a block and queries handled against it by one task; both bound a task's memory.
BLOCK, QUERIES = 32768, 8192

OUT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part: id not null, vector not null, not zero, all components finite numbers."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine & F.exists("v", lambda x: x != 0))


def choose_pivots(rows: DataFrame, n: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots spread over a sample of at most `sample` distinct vectors: each is the farthest of 8 tries from those taken."""
    h = F.xxhash64("v")
    share = min(1.0, 4.0 * sample / max(n, 1))
    picked = rows.filter(F.pmod(h, F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).withColumn("h", h).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(sample).select("v").collect()
    if not picked:
        return np.zeros((0, 0))
    width = max({len(r.v) for r in picked}, key=lambda w: sum(len(r.v) == w for r in picked))
    x = np.array([r.v for r in picked if len(r.v) == width])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(5)
    order = rng.permutation(len(x))
    taken = [int(order[0])]
    near = x @ x[taken[0]]
    while len(taken) < min(pivots, len(x)):
        tries = rng.choice(len(x), min(8, len(x)), replace=False)
        best = int(tries[np.argmin(near[tries])])
        if best in taken:
            left = np.setdiff1d(np.arange(len(x)), taken)
            best = int(left[np.argmin(near[left])])
        taken.append(best)
        near = np.maximum(near, x @ x[best])
    return x[taken]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each vector, in order (ties to the earlier pivot)."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k]


def inverted_files(orders: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vectors, places) for each pivot."""
    flat = orders.reshape(-1)
    by = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[by], np.arange(pivots + 1))
    vector, place = by // orders.shape[1], by % orders.shape[1]
    return [(vector[a:b].astype(np.int32), place[a:b].astype(np.int16)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int, share: float, least: int):
    """(query, id, score) of the best k of this block for each query, by footrule and exact rerank.

    Equal vectors are one entry of the index, with all their ids, so copies can't
    crowd others out of the reranked share.
    """
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]).any(axis=1)
    first = np.append(np.flatnonzero(fresh), len(x))
    ux = np.ascontiguousarray(x[first[:-1]])
    posted, read = min(POSTED, len(pivots)), min(READ, len(pivots))
    files = inverted_files(nearest_pivots(ux, pivots, posted), len(pivots))
    # By the places in the query and in the vector: how much less the footrule is than for a vector that isn't posted.
    here, there = np.arange(read)[:, None], np.arange(posted)[None, :]
    less = (np.abs(posted - here) - np.abs(there - here)).astype(np.int16)
    c = min(len(ux), max(least, math.ceil(share * len(ux)), 2 * k))
    found = [[], [], []]
    total, in_order = np.empty(len(ux), np.int16), np.sort(ids)
    for qid, v, own in zip(q_ids, q, nearest_pivots(q, pivots, read), strict=True):
        total[:] = 0
        for at, p in enumerate(own):
            vector, place = files[p]
            total[vector] += less[at][place]
        near = np.argpartition(-total, c - 1)[:c] if c < len(ux) else np.arange(len(ux))
        score = (ux[near] * v).sum(axis=1)  # each row is summed in one order, so copies tie exactly
        most = k + int(np.searchsorted(in_order, qid, "right") - np.searchsorted(in_order, qid))  # with rows that have the query's own id
        if len(near) > most:
            cut = np.partition(score, len(score) - most)[len(score) - most]
            near, score = near[score >= cut], score[score >= cut]
        lists = [ids[first[u] : min(first[u + 1], first[u] + most)] for u in near]  # ids ascend
        vec, s = np.concatenate(lists), np.repeat(score, [len(a) for a in lists])
        s, vec = s[vec != qid], vec[vec != qid]
        top = np.lexsort((vec, -s))[:k]
        for to, values in zip(found, (np.full(len(top), qid), vec[top], s[top]), strict=True):
            to.append(values)
    return [np.concatenate(a) if a else np.zeros(0, t) for a, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS, sample: int = SAMPLE, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The k nearest found by inner product: query_id long, rank int from 1, vec_id long, score double.

    Ties go to the smaller id, copies included. Vectors that are null, zero, hold
    null or non-finite components, have a null id, or not the width that most of
    the sample has, take no part. A row with the query's own id is never its
    candidate; other rows that repeat an id are candidates each, and of queries that
    repeat one the least vector asks. An empty table gives an empty result. Blocks are
    dealt by id and vector, so a hot one is spread out.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    n, nq = rows.count(), asked.count()
    points = choose_pivots(rows, n, pivots, sample)
    if not n or not nq or not len(points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = points.shape[1]
    blocks, parts = max(math.ceil(n / BLOCK), min(8, math.ceil(n / 512))), math.ceil(nq / QUERIES)
    fits = F.size("v") == width
    deal = lambda df, own, other, m, k: df.withColumns({own: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))})
    once = asked.filter(fits).groupBy("id").agg(F.min("v").alias("v"))
    left, right = deal(rows.filter(fits), "b", "p", blocks, parts), deal(once, "p", "b", parts, blocks)

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t["v"].combine_chunks()
        flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
        return flat.to_numpy(zero_copy_only=False).reshape(-1, width)

    def task(own: pa.Table, ask: pa.Table) -> pa.Table:
        if own.num_rows and ask.num_rows:
            out = search_block(ask["id"].to_numpy(), matrix(ask), own["id"].to_numpy(), matrix(own), points, k, share, least)
        else:
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, out), strict=True)))

    found = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(task, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    from srcatlas.llm._store import table

    rows = table(spark, sf_dir, "embeddings")
    return knn(rows, rows.filter("vec_id % 20 = 0"), k=20)
