"""Exact top-k inner products over norm-sorted, rotated vectors.

Vectors are dealt into lanes by descending length. All queries go through the lane of the longest vectors first; the
k-th best score there is a query's bar. A query then goes only to the lanes whose longest vector could reach its bar.
A task takes a block of queries and one lane and goes through it from the longest vector down, step by step. Both
sides are rotated by the same orthogonal matrix (from an SVD), which leaves inner products alone and moves most of
their mass into the first coordinates. From the partial product there, Cauchy-Schwarz bounds what the rest can add;
only pairs whose bound reaches the query's k-th best score so far are scored, in exact integers. A lane ends for a
query where even the product of both lengths can't reach it. Tasks give at most k rows for each query; these are
ranked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import some
from graphloom.session import cut, prepare

#: Rows of a lane of candidates and of a block of queries: what one task holds.
LANE, QUERIES, STEP = 8192, 4096, 1024
#: Vectors that the rotation is fitted on (any rotation gives exact results), and the share of their mass wanted in the head.
FIT_VECTORS, HEAD_MASS = 4096, 0.7
#: Below this product of lengths, float64 sums of integer products are exact.
EXACT = 2.0**52


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v array<double>, norm): floor(scale * x) of each component, as whole doubles.

    Rows with a null id, a null vector, or a null or non-finite component (also after scaling) are left out.
    """
    prepare(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            col = b.column(1)
            flat = np.asarray(col.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
            size = np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                flat = np.floor(flat * scale)
            bad = np.zeros(len(size) + 1, np.int64)
            row = np.repeat(np.arange(len(size)), size)
            np.add.at(bad, row[~np.isfinite(flat)], 1)
            ok = (bad[:-1] == 0) & np.asarray(col.is_valid()) & np.asarray(b.column(0).is_valid())
            sq = np.bincount(row, np.where(np.isfinite(flat), flat, 0) ** 2, len(size))
            keep = ok[row]
            out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[ok])].astype(np.int32)), pa.array(flat[keep]))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), out, pa.array(np.sqrt(sq[ok]))], ["id", "v", "norm"])

    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    return own.mapInArrow(run, "id long, v array<double>, norm double")


def rotation(sample: np.ndarray) -> tuple[np.ndarray, int]:
    """An orthogonal matrix by SVD of the sample, and how many coordinates hold most of the mass after it."""
    _, s, vt = np.linalg.svd(sample, full_matrices=True)
    mass = np.cumsum(np.r_[s**2, np.zeros(vt.shape[0] - len(s))])
    head = int(np.searchsorted(mass, HEAD_MASS * mass[-1])) + 1 if mass[-1] > 0 else 1
    return vt.T, min(head, max(1, sample.shape[1] // 2))


def _matrix(rows: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix, shorter ones filled with zeros."""
    rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    size = np.asarray(pa.compute.list_value_length(rows), np.int64)
    flat = np.asarray(rows.flatten())
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Inner products of rows in whole numbers of any size."""
    return [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]


def _low(scores: np.ndarray, whole: bool) -> np.ndarray:
    """Scores as doubles that are no higher."""
    x = scores.astype(np.float64)
    return x if whole else x - 1e-12 * np.abs(x)


def search(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, turn: np.ndarray, head: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of each query's k best in c but itself, of those that reach its bar; ties to smaller ids."""
    cn = np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((cid, -cn))
    cid, c, cn = cid[order], c[order], cn[order]
    qn = np.sqrt((q * q).sum(axis=1))
    whole = (qn.max(initial=0) + 1) * (cn.max(initial=0) + 1) < EXACT
    rq, rc = q @ turn, c @ turn
    tq = np.sqrt(np.maximum(0, (rq[:, head:] ** 2).sum(axis=1)))
    tc = np.sqrt(np.maximum(0, (rc[:, head:] ** 2).sum(axis=1)))
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64 if whole else object)
    least = np.full(len(q), -np.inf) if bar is None else bar.copy()
    for at in range(0, len(c), STEP):
        to = slice(at, at + STEP)
        slack = 1e-9 * (qn * cn[at] + 1)
        live = np.flatnonzero(qn * cn[at] + slack >= least)
        if not len(live):
            break
        bound = rq[live, :head] @ rc[to, :head].T + tq[live, None] * tc[None, to] + slack[live, None]
        hit = (bound >= least[live, None]) & (qid[live, None] != cid[None, to])
        i, j = np.nonzero(hit)
        i, j = live[i], j + at
        if not len(i):
            continue
        if whole and len(i) * 8 > hit.size:
            new = (q[live] @ c[to].T)[hit]
        elif whole:
            new = np.concatenate([np.einsum("ij,ij->i", q[i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
        else:
            new = np.array(_exact(q[i], c[j]), object)
        good = new >= least[i] if whole else np.array([x >= y for x, y in zip(new, least[i].tolist(), strict=True)], bool)
        rows, ids, scores = np.r_[rows, i[good]], np.r_[ids, cid[j[good]]], np.r_[scores, new[good]]
        best = np.lexsort((ids, -scores, rows)) if whole else np.array(sorted(range(len(rows)), key=lambda x: (rows[x], -scores[x], ids[x])), np.int64)
        rows, ids, scores = rows[best], ids[best], scores[best]
        start = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - start < k
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True]) if len(rows) else []
        full = [x for x in last if x - np.searchsorted(rows, rows[x]) == k - 1]
        if full:
            least[rows[full]] = np.maximum(least[rows[full]], _low(scores[full], whole))
    return rows, ids, scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products over all other vectors.

    ``vectors`` and ``queries`` as from quantize(). Fewer than k others: all of them. Ties go to the smaller id;
    a vector is no candidate for a query of the same id, also where ids repeat (each repeated candidate row
    counts once more; repeated query rows are answered once, of unlike ones the least vector). Vectors of unequal
    lengths are filled with zeros. Empty tables give no rows. Scores beyond 63 bits aren't representable and fail.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors)
    queries = queries.groupBy("id").agg(F.min(F.struct("v", "norm")).alias("m")).select("id", "m.v", "m.norm")
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    n, width = facts.n, max(1, facts.d)
    drawn = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // FIT_VECTORS))) == 0).select("v").limit(2 * FIT_VECTORS).toArrow()
    turn, head = rotation(_matrix(drawn.column("v"), width) if drawn.num_rows else np.zeros((1, width)))
    shared = spark.sparkContext.broadcast((turn, head))
    lanes = -(-n // LANE) or 1
    blocks = -(-queries.count() // QUERIES) or 1
    # lane 0 has the longest vectors; equal lengths are dealt over their lanes by a hash
    order = F.struct((-F.col("norm")).alias("down"), F.xxhash64("id").alias("h"))
    dealt = cut(vectors.repartitionByRange(lanes, order).withColumn("lane", F.spark_partition_id()))
    longest = cut(dealt.groupBy("lane").agg(F.max("norm").alias("top")))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(blocks)).cast("int"))

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        turn, head = shared.value
        is_query = table.column("query")
        q, c = table.filter(is_query), table.filter(pa.compute.invert(is_query))
        qid, cid = (np.asarray(x.column("id"), np.int64) for x in (q, c))
        if not len(qid) or not len(cid):
            rows = ids = scores = np.zeros(0, np.int64)
        else:
            rows, ids, scores = search(qid, _matrix(q.column("v"), width), cid, _matrix(c.column("v"), width), k, turn, head, np.asarray(q.column("bar"), np.float64))
        return pa.table({"query_id": pa.array(qid[rows], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array([int(s) for s in scores], pa.int64())})

    def found(asked: DataFrame) -> DataFrame:
        """asked: id, v, block, lane, bar."""
        wanted = asked.select("lane", "block").distinct()
        left = dealt.join(wanted, "lane").select("lane", "block", "id", "v", F.lit(0.0).alias("bar"), F.lit(False).alias("query"))
        both = left.unionByName(asked.select("lane", "block", "id", "v", "bar", F.lit(True).alias("query")))
        return both.groupBy("lane", "block").applyInArrow(run, "query_id long, vec_id long, score long")

    first = longest.agg(F.min("lane")).first()[0] or 0
    low = F.lit(float("-inf"))
    best = cut(found(asked.withColumn("lane", F.lit(first)).withColumn("bar", low)))
    # the k-th best so far, a little lower where doubles aren't exact
    bars = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("s"))
    bar = F.coalesce(F.col("s") - F.abs("s") * 1e-12, low)
    later = asked.join(bars, "id", "left").withColumn("bar", bar).join(F.broadcast(longest.where(F.col("lane") > first)), F.col("norm") * F.col("top") * (1 + 1e-9) + 1e-9 >= F.col("bar"))  # a row for each lane
    everything = best.unionByName(found(later.select("id", "v", "block", "lane", "bar")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
