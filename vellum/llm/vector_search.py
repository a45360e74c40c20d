"""Exact nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; a tile is one block of each. In a tile both sides are rounded to int8 with
a scale for each vector, so that one integer matrix product gives every inner product up to a known error: with
x = s(i + e), |e| <= 1/2, the product of two such vectors differs from s t (i . j) by at most
s t (|i|_1 + |j|_1) / 2 + s t n / 4. Pairs whose upper bound is under the k-th largest lower bound can't be among the k
nearest; the others are computed anew in double precision. Equal vectors of a tile are scored once and keep the k + 1
smallest ids, which suffices as ties go to those. Heaps merge the tiles' lists.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows and their scales; a row is about scale x int8, each component off by half the scale at most."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).clip(-127, 127).astype(np.int8), scale


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def nearest_in_tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score): the k nearest of the tile for each query; a candidate with the query's id is skipped."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    c, same = np.unique(c, axis=0, return_inverse=True)
    order = np.argsort(same.ravel(), kind="stable")
    start = np.searchsorted(same.ravel()[order], np.arange(len(c) + 1))
    ids = [cid[order[a : min(b, a + k + 1)]] for a, b in zip(start[:-1], start[1:], strict=True)]
    qi, qs = quantise(q)
    ci, cs = quantise(c)
    dims = q.shape[1]
    # float32 holds these integer sums exactly as long as dims * 127 * 127 < 2^24
    kind = np.float32 if dims <= 1040 else np.float64
    ci_t, ca = ci.T.astype(kind), np.abs(ci.astype(np.int64)).sum(axis=1)
    slack = 1e-9 + 1e-12 * dims
    out = []
    for at in range(0, len(q), 128):
        part = slice(at, at + 128)
        scale = qs[part, None] * cs
        about = (qi[part].astype(kind) @ ci_t) * scale
        error = scale * ((np.abs(qi[part].astype(np.int64)).sum(axis=1)[:, None] + ca) / 2 + dims / 4) * (1 + slack) + np.abs(about) * slack
        low = about - error
        # one more than k: the query itself may be among them
        least = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)] if low.shape[1] > k + 1 else np.full(len(low), -np.inf)
        row, col = np.nonzero(about + error >= least[:, None])
        score = inner(q[at + row], c[col])
        cut = np.searchsorted(row, np.arange(len(low) + 1))
        for i in range(len(low)):
            own, a, b = qid[at + i], cut[i], cut[i + 1]
            best = np.argsort(-score[a:b], kind="stable")
            heap: list[tuple[float, int]] = []
            floor = None
            for j in best.tolist():
                s = float(score[a + j])
                if len(heap) >= k and s < floor:
                    break
                heap += [(-s, int(v)) for v in ids[col[a + j]] if v != own]
                floor = s
            out += [(int(own), v, -s) for s, v in heapq.nsmallest(k, heap)]
    return out


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector that isn't null, empty or zero and holds finite numbers only."""
    v = F.transform(F.col(f"`{column}`"), lambda x: x.cast("double"))
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("vec")).where("id is not null").where(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0))


def search(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (id, vec) its k nearest candidates (id, vec) by inner product.

    All vectors have one length. Ties go to the smaller id; a query's own id is no candidate for it; fewer than k
    candidates: all. Repeated ids: repeated queries are searched once, repeated candidates (equal rows) counted once.
    An empty side gives an empty result. Blocks hold about QUERY_BLOCK and CANDIDATE_BLOCK rows whatever the tables hold,
    so a tile's memory is fixed; each side is sent once for each block of the other.
    """
    queries, candidates = queries.dropDuplicates(["id"]), candidates.dropDuplicates(["id", "vec"])
    n_q, n_c = queries.count(), candidates.count()
    blocks_q, blocks_c = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CANDIDATE_BLOCK))

    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int").alias(mine)
        return df.select("id", "vec", block, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    q = dealt(queries, blocks_q, blocks_c, "qb", "cb").withColumn("is_query", F.lit(True))
    c = dealt(candidates, blocks_c, blocks_q, "cb", "qb").withColumn("is_query", F.lit(False))

    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("vec").combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def tile(t: pa.Table) -> pa.Table:
        is_query = t.column("is_query")
        a, b = t.filter(is_query), t.filter(pa.compute.invert(is_query))
        rows = nearest_in_tile(a.column("id").to_numpy(), matrix(a), b.column("id").to_numpy(), matrix(b), k) if len(a) and len(b) else []
        x = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({"query_id": pa.array(x[0], pa.int64()), "vec_id": pa.array(x[1], pa.int64()), "score": pa.array(x[2], pa.float64())})

    found = q.unionByName(c).groupBy("qb", "cb").applyInArrow(tile, "query_id long, vec_id long, score double")

    def merge(t: pa.Table) -> pa.Table:
        rows = heapq.nsmallest(k, set(zip([-s for s in t.column("score").to_pylist()], t.column("vec_id").to_pylist(), strict=True)))
        query = t.column("query_id")[0].as_py()
        return pa.table({"query_id": pa.array([query] * len(rows), pa.int64()), "rank": pa.array(range(1, len(rows) + 1), pa.int32()), "vec_id": pa.array([v for _, v in rows], pa.int64()), "score": pa.array([-s for s, _ in rows], pa.float64())})

    return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")
