"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Every partition reduces its integer vectors to a state: their number, sums, all singular values and
right singular vectors of the centred rows. Two states merge without loss: the rows of both, singular values times
vectors, are stacked with one row that accounts for the difference of the means, and decomposed
again. States merge in groups, level by level, until one is left; a state has as many rows as a
vector has components at most, so no task ever holds more than a group of such squares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rulewright.llm.common import stored
from rulewright.llm.topk import quantised, takes_part

#: Components returned; states that merge at a time; rows that a task decomposes at a time; the part of the largest singular value below which one counts as none.
COMPONENTS, FAN, ROWS, NONE = 4, 8, 4096, 1e-12

State = tuple[int, np.ndarray, np.ndarray, np.ndarray]
_STATE = "n long, sums binary, s binary, v binary"


def decomposed(rows: np.ndarray) -> State:
    """The state of some integer rows: n, sums, singular values and right singular vectors (by row) of the centred rows."""
    sums = rows.sum(axis=0)
    _, s, v = np.linalg.svd(rows - sums / len(rows), full_matrices=False)
    return len(rows), sums, s, v


def merged(a: State, b: State) -> State:
    """The state of both states' rows; a narrower one counts as if zeros followed."""
    width = max(len(a[1]), len(b[1]))
    (n, sums, s, v), (m, others, t, w) = (_widened(x, width) for x in (a, b))
    apart = np.sqrt(n * m / (n + m)) * (sums / n - others / m)
    _, out, vectors = np.linalg.svd(np.concatenate((s[:, None] * v, t[:, None] * w, apart[None, :])), full_matrices=False)
    return n + m, sums + others, out[:width], vectors[:width]


def _widened(state: State, width: int) -> State:
    n, sums, s, v = state
    more = width - len(sums)
    return state if not more else (n, np.pad(sums, (0, more)), s, np.pad(v, ((0, 0), (0, more))))


def _as_row(state: State) -> pa.RecordBatch:
    n, *arrays = state
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays)], names=["n", "sums", "s", "v"])


def _of_row(row: dict) -> State:
    sums, s, v = (np.frombuffer(row[c], kind) for c, kind in (("sums", np.int64), ("s", np.float64), ("v", np.float64)))
    return row["n"], sums, s, v.reshape(len(s), len(sums))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Integer lists as rows; shorter lists are followed by zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state of a partition's vectors."""
    state = None
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            more = decomposed(_matrix(batch.column(0).slice(at, ROWS)))
            state = more if state is None else merged(state, more)
    if state is not None:
        yield _as_row(state)


def _merge(part: pa.Table) -> pa.Table:
    first, *rest = sorted(part.drop_columns(["bucket"]).to_pylist(), key=lambda r: (r["n"], r["sums"], r["s"], r["v"]))
    state = _of_row(first)
    for row in rest:
        state = merged(state, _of_row(row))
    return pa.Table.from_batches([_as_row(state)])


def fitted(vectors: DataFrame) -> State | None:
    """The state of all rows of the integer array column ``x``; None without rows.

    What comes to the driver is one state, of as many numbers as a vector has components, squared.
    """
    states = stored(vectors.select("x").mapInArrow(_states, _STATE))
    left = states.count()
    while left > 1:
        buckets = -(-left // FAN)
        order = F.pmod(F.xxhash64("sums", "s"), F.lit(buckets)).cast("int").alias("bucket")
        states = stored(states.select(order, "*").groupBy("bucket").applyInArrow(_merge, _STATE))
        left = states.count()
    found: Row | None = states.first()
    return None if found is None else _of_row(found.asDict())


def whitened(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Projections on the principal components, scaled to variance 1: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c count as the integer floor(scale * c). Rows whose vector is null or holds null or non-finite
    entries go. The components are fitted to the distinct vectors x, of which there are n
    with sums S, covariances having the divisor n; they are numbered from 1 by falling eigenvalue e, and each
    vector's largest entry (the first of equal ones) is positive. deviation is the sum of (n x - S)^2,
    exact, an error where it exceeds 64 bits; whitened is (x - S / n) on the component over sqrt(e),
    explained is e over the covariances' trace, and identity_error the largest absolute difference of
    the whitened distinct vectors' covariance from the identity, the same in every row.

    Every remaining row is returned for each component up to ``components``, rows with a null id and
    rows that repeat included. Components without variance are none: there are at most as many as a
    vector has entries and n - 1, so a single distinct vector, or an empty table, gives no rows.
    Of vectors of different lengths the shorter count as if zeros followed. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v")).filter(takes_part(F.col("v")))
    rows = rows.select("vec_id", quantised(F.col("v"), scale).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    rows = stored(rows.select("vec_id", padded.alias("x")))
    fit = stored(rows.select("x").distinct())
    state = fitted(fit)
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    if state is None or not state[2].size or not state[2][0]:
        return spark.createDataFrame([], schema)
    n, sums, s, v = state
    take = int((s[:components] > NONE * s[0]).sum())
    e = s**2 / n
    signs = np.sign(v[np.arange(take), np.abs(v[:take]).argmax(axis=1)])
    axes = v[:take] * signs[:, None] / np.sqrt(e[:take])[:, None]
    literal = lambda values, kind: F.array(*[F.lit(x) for x in values]).cast(f"array<{kind}>")
    exact, mean = literal(sums.tolist(), "bigint"), literal((sums / n).tolist(), "double")
    centred = F.zip_with("x", mean, lambda x, m: x - m)

    def projected(axis: np.ndarray) -> Column:
        return F.aggregate(F.zip_with("centred", literal(axis.tolist(), "double"), lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)

    scored = lambda df: df.withColumn("centred", centred).select("*", *[projected(axis).alias(f"z{k}") for k, axis in enumerate(axes)]).drop("centred")
    pairs = [(i, j) for i in range(take) for j in range(i, take)]
    covariances = scored(fit).agg(*[F.covar_pop(f"z{i}", f"z{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariances, pairs, strict=True))
    deviation = F.aggregate(F.zip_with("x", exact, lambda x, t: x * F.lit(n) - t), F.lit(0).cast("long"), lambda a, d: a + d * d)
    explained = e[:take] / e.sum()
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"z{k}").alias("whitened"), F.lit(float(explained[k])).alias("explained")) for k in range(take)]))
    out = scored(rows.withColumn("deviation", deviation)).select("vec_id", "deviation", each.alias("c"))
    return out.select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(float(error)).alias("identity_error"))
