"""Operator 9: exact top-k search.

Columnar branch-and-bound.  Candidates lie in blocks of vertical layout (one
run of memory for each dimension).  A query's inner products are accumulated
dimension block by dimension block, the dimensions with the most mass first.
After each dimension block the mass that remains in the query and in each
candidate bounds what the rest can add (Cauchy-Schwarz); candidates whose best
case is under the k-th best worst case are compacted away.

Queries are blocks too, so neither side is ever held whole: a task scores one
block of queries against one block of candidates, carries a query's k-th best
score on to the next block as a bar, and returns at most k rows
for each query and block, which a window merges.  Query blocks are broadcast
while they take up to BROADCAST_BYTES; beyond that both sides are dealt over a
grid of groups of blocks and joined on its cells.

Vectors are scaled to integers, floor(scale * x) with x as double, so scores
are exact.  Null vectors and vectors with null or non-finite components take
no part; nor do those whose length differs from the query's.  A query is not
its own candidate; rows that repeat its id are its own too.  Ties go to the
smaller id.  Every candidate row counts, repeated ones too; a repeated query id
counts once, by its least vector.  Columns besides id and vector play no part.
Without queries or candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SCALE = 1024
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 4096
DIMENSION_BLOCK = 16
#: Query blocks are broadcast up to this size; a group of the grid has so many bytes of queries or so many candidate blocks.
BROADCAST_BYTES = 32 << 20
GROUP_BLOCKS = 64
#: Sums below this are exact as doubles.
EXACT = float(1 << 53)
#: Components beyond this count as this; scores are cut to what a long holds.
LARGEST = float(1 << 62)


def usable(vector: Column) -> Column:
    """True for vectors whose components are all present and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _blocks(rows: DataFrame, size: int, tag: str, scale: int) -> DataFrame:
    """Rows (id, v) as blocks: ids, vertical matrix of int64 as bytes, number of dimensions."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(d: int) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(d), strict=True)
            matrix = np.ascontiguousarray(np.array(vectors, dtype=np.int64).reshape(len(ids), d).T)
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([matrix.tobytes()]), pa.array([d], pa.int32())], [f"{tag}_ids", f"{tag}_m", f"{tag}_d"])

        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy()
            flat = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            flat = np.clip(flat, -LARGEST, LARGEST)
            base = offsets[0]
            for i, key in enumerate(batch.column(0).to_pylist()):
                v = flat[offsets[i] - base : offsets[i + 1] - base]
                held.setdefault(len(v), []).append((key, v))
                if len(held[len(v)]) >= size:
                    yield out(len(v))
        for d in list(held):
            yield out(d)

    return rows.mapInArrow(pack, f"{tag}_ids binary, {tag}_m binary, {tag}_d int")


def search_block(queries: np.ndarray, candidates: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, step: int = DIMENSION_BLOCK, bars: dict[int, np.ndarray] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (a column of ``queries``), the k best (score, id) among the columns of ``candidates``.

    Both are dimensions x vectors.  ``own`` has the queries' ids.  ``bars`` keeps
    the k best scores of each query over several calls; candidates that must
    stay under the k-th are let go.  Returns (query, ids, scores), scores falling, then ids rising.
    """
    d = len(candidates)
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(d, 1)
    exact = top < EXACT
    q, c = (queries.astype(np.float64), candidates.astype(np.float64)) if exact else (queries.astype(object), candidates.astype(object))
    mass = (candidates.astype(np.float64) ** 2).sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    q, c = q[order], c[order]
    cuts = list(range(0, d, step))
    fq, fc = q.astype(np.float64), c.astype(np.float64)
    rest_q = [np.sqrt((fq[a + step :] ** 2).sum(axis=0)) for a in cuts]
    rest_c = [np.sqrt((fc[a + step :] ** 2).sum(axis=0)) for a in cuts]
    first = q[:step].T @ c[:step] if cuts else np.zeros((q.shape[1], c.shape[1]))
    out = []
    for j in range(q.shape[1]):
        left = np.flatnonzero(ids != own[j])
        partial = first[j, left]
        seen = bars.get(int(own[j])) if bars is not None and exact else None
        floor = seen[0] if seen is not None and len(seen) == k else -np.inf
        for b, a in enumerate(cuts):
            if b:
                partial = partial + q[a : a + step, j] @ c[a : a + step, left]
            slack = rest_q[b][j] * rest_c[b][left] * (1 + 1e-9) + (b < len(cuts) - 1)
            if not exact:
                slack = slack + 1e-9 * np.abs(partial.astype(np.float64))
            if len(left) > k:
                worst = (partial - slack).astype(np.float64)
                bar = max(floor, np.partition(worst, len(worst) - k)[len(worst) - k])
            else:
                bar = floor
            if bar > -np.inf:
                keep = (partial + slack).astype(np.float64) >= bar
                left, partial = left[keep], partial[keep]
        best = np.lexsort((ids[left], -partial.astype(np.float64)))[:k] if exact else np.array(sorted(range(len(left)), key=lambda i: (-partial[i], ids[left[i]]))[:k], dtype=int)
        out.append((int(own[j]), ids[left[best]], partial[best]))
        if bars is not None and exact:
            scores = np.sort(np.concatenate([seen if seen is not None else np.empty(0), partial[best].astype(np.float64)]))
            bars[int(own[j])] = scores[-k:]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, scale: int = SCALE) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries``: query_id, rank, vec_id, score."""

    def rows(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector), lambda x: x.cast("double"))
        return df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), v.alias("v"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["c_d"] != r["q_d"]:
                    continue
                own, ids, d = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64), r["c_d"]
                found = search_block(np.frombuffer(r["q_m"], np.int64).reshape(d, len(own)), np.frombuffer(r["c_m"], np.int64).reshape(d, len(ids)), k, own, ids, bars=bars)
                q = np.concatenate([np.full(len(i), o) for o, i, _ in found] or [np.empty(0, np.int64)])
                i = np.concatenate([i for _, i, _ in found] or [np.empty(0, np.int64)])
                s = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for _, _, s in found for x in s]
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    scratch = Scratch(vectors.sparkSession, "topk")
    asked = scratch.save(rows(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n = asked.count()
    q = scratch.save(_blocks(asked.coalesce(1 + n // query_block), query_block, "q", scale), "query-blocks")
    c = scratch.save(_blocks(rows(vectors), candidate_block, "c", scale), "candidate-blocks")
    size = q.agg(F.coalesce(F.sum(F.octet_length("q_m")), F.lit(0))).first()[0]
    # a stated set of queries against all rows, block by block
    if size <= BROADCAST_BYTES:
        pairs = c.crossJoin(F.broadcast(q))
    else:
        across, down = 1 + size // BROADCAST_BYTES, 1 + c.count() // GROUP_BLOCKS
        queries_ = q.withColumns({"_x": F.pmod(F.xxhash64("q_ids"), F.lit(across)), "_y": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
        candidates = c.withColumns({"_y": F.pmod(F.xxhash64("c_ids"), F.lit(down)), "_x": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
        pairs = candidates.join(queries_, ["_x", "_y"]).drop("_x", "_y")
    best = pairs.mapInArrow(scored, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
