"""Exact top-k inner products by aggregation without random access over sorted lists.

A block of candidates has, for each component, one list sorted by that component's value. A query
reads all lists to the same depth, from the end at which its own component makes the largest
contributions. What was read bounds every candidate's score: contributions not read yet are at
most the last one read of their list, and at least the list's worst. The bounds are looked at at
rising depths, for each query by itself: once few candidates can still reach the k-th lower bound, no
outsider qualifies, the query reads no further and their scores are resolved exactly. A query
that never gets so far has read its lists to the end, where both bounds are the score; that last step is
one product of what is left of the queries with all candidates.

Blocks of queries meet blocks of candidates by a join, and each pair of blocks keeps k rows for
each query; so no task holds more than two blocks, however many vectors there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES, AT_ONCE = 8192, 2048, 128
#: Parts of a list's length after which a query's bounds are looked at; one that goes on after the last reads its lists to the end.
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.8125, 0.875, 0.9375)
#: Candidates for each query, in multiples of k, that are few enough to resolve.
FEW = 16
_EXACT32, _EXACT64 = 1 << 24, 1 << 53


def takes_part(vector: Column) -> Column:
    """Whether a vector is not null and holds finite components only."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(False))


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, as integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(rows, len(data) // (8 * rows))


def _packed(arrays: pa.Array) -> np.ndarray:
    """One row of a matrix for each list; shorter lists are followed by zeros."""
    sizes = arrays.value_lengths().to_numpy(zero_copy_only=False)
    flat = arrays.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _block(part: pa.Table) -> tuple[pa.Array, pa.Array]:
    """The ids and the matrix of rows (id, v), as bytes."""
    ids = part.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array([ids.tobytes()], pa.binary()), pa.array([_packed(part.column("v").combine_chunks()).tobytes()], pa.binary())


def _query_block(part: pa.Table) -> pa.Table:
    return pa.table([part.column("bucket")[:1], *_block(part)], names=["bucket", "q_ids", "q_data"])


def _candidate_blocks(size: int):
    """Packs rows (id, v) into blocks of ``size`` rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            while rows >= size:
                table = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_arrays([*_block(table.slice(0, size))], names=["c_ids", "c_data"])
                held = table.slice(size).to_batches()
                rows -= size
        if rows:
            yield pa.RecordBatch.from_arrays([*_block(pa.Table.from_batches(held))], names=["c_ids", "c_data"])

    return run


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, stops: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query within one block: query ids, candidate ids, scores.

    Candidates with the query's own id don't count; ties go to the smaller id. ``stops`` counts at
    which part of the lists' length queries stopped.
    """
    stops = Counter() if stops is None else stops
    width = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, vectors))
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(width, 1)
    # bounds add up to four terms of this size
    kind = np.float32 if 4 * largest < _EXACT32 else np.float64 if 4 * largest < _EXACT64 else np.int64
    n = len(ids)
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(vectors, order, axis=0).astype(kind)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    exact = vectors.astype(kind)
    by_depth = {}
    for part in DEPTHS:
        depth = min(n, max(k + 1, int(n * part)))
        if depth < n and depth not in by_depth:
            read = np.concatenate((rank >= n - depth, rank < depth), axis=1)
            by_depth[depth] = part, np.concatenate((np.concatenate((exact, exact), axis=1) * read, read.astype(kind)), axis=1)
    found = ([], [], [])

    def resolve(rows: np.ndarray, candidates: np.ndarray, scores: np.ndarray) -> None:
        """Keeps the k best of (query row, candidate, exact score) for each query row."""
        by = np.lexsort((ids[candidates], -scores, rows))
        rows, candidates, scores = rows[by], candidates[by], scores[by]
        starts = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - starts < k
        for out, x in zip(found, (query_ids[rows[keep]], ids[candidates[keep]], scores[keep]), strict=True):
            out.append(x)

    def step(rows: np.ndarray) -> None:
        some = queries[rows].astype(kind)
        signed = np.concatenate((np.maximum(some, 0), np.minimum(some, 0)), axis=1)
        own = query_ids[rows][:, None] == ids[None, :]
        left = np.arange(len(rows))
        worst = np.concatenate((lists[0], lists[-1])) * signed
        for depth, (part, read) in by_depth.items():
            last = np.concatenate((lists[n - depth], lists[depth - 1])) * signed[left]
            lower = np.concatenate((signed[left], -worst[left]), axis=1) @ read.T + worst[left].sum(axis=1, keepdims=True)
            upper = np.concatenate((signed[left], -last), axis=1) @ read.T + last.sum(axis=1, keepdims=True)
            lowest = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
            lower[own[left]] = lowest
            upper[own[left]] = lowest
            bar = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(left), lowest)
            open_ = (upper >= bar[:, None]) & ~own[left]
            done = open_.sum(axis=1) <= FEW * k
            if done.any():
                stops[part] += int(done.sum())
                at, candidates = np.nonzero(open_[done])
                mine = left[done][at]
                resolve(rows[mine], candidates, (queries[rows[mine]] * vectors[candidates]).sum(axis=1))
                left = left[~done]
            if not len(left):
                return
        # the lists are read to their ends: every score is known
        stops[1.0] += len(left)
        scores = some[left] @ exact.T
        if n > k + 1:
            masked = np.where(own[left], np.iinfo(np.int64).min if kind is np.int64 else -np.inf, scores)
            bar = np.partition(masked, n - k, axis=1)[:, n - k]
            at, candidates = np.nonzero((masked >= bar[:, None]) & ~own[left])
        else:
            at, candidates = np.nonzero(~own[left])
        resolve(rows[left[at]], candidates, scores[at, candidates].astype(np.int64))

    if n:
        for start in range(0, len(queries), AT_ONCE):
            step(np.arange(start, min(start + AT_ONCE, len(queries))))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _pairs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                q, c = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["c_ids"], np.int64)
                rows = best_of_block(q, _matrix(x["q_data"], len(q)), c, _matrix(x["c_data"], len(c)), k)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """The k highest inner products of each query's quantised vector: query_id, rank (from 1), vec_id, score.

    Components x count as floor(scale * x). Queries are the rows for which ``is_query`` holds,
    candidates all rows with another id; ties go to the smaller vec_id, and with fewer than k
    candidates all are returned. Vectors that are null or hold null or non-finite components take
    no part, and neither do rows with a null id. A shorter vector counts as if zeros followed. Of
    rows that repeat an id, each is a candidate, and the least vector is the query. Scores are
    exact as long as they fit 64 bits. An empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v"), is_query.alias("asks")).filter(F.col("id").isNotNull() & takes_part(F.col("v")))
    rows = rows.select("id", quantised(F.col("v"), scale).alias("v"), "asks")
    asked = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    buckets = max(1, -(-asked.count() // queries))
    # with few blocks of queries, copies of them meet other slices of the candidates' blocks
    slices = max(1, -(-int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asks = asked.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), "id", "v").groupBy("bucket").applyInArrow(_query_block, "bucket int, q_ids binary, q_data binary")
    own = rows.select("id", "v").mapInArrow(_candidate_blocks(candidates), "c_ids binary, c_data binary")
    own = own.withColumn("slice", F.pmod(F.xxhash64("c_ids"), F.lit(slices)).cast("int")).withColumn("bucket", every(buckets))
    met = own.join(asks.withColumn("slice", every(slices)), ["bucket", "slice"])
    return ranked(met.select("q_ids", "q_data", "c_ids", "c_data").mapInArrow(_pairs(k), "query_id long, vec_id long, score long"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of (query_id, vec_id, score) by query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
