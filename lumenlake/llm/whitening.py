"""Embedding whitening with eigenvectors refined in mixed precision.

Components become integers x = floor(256 * c).  The fit list is each distinct x vector once.  Its sums and
second moments are exact: every task centres its vectors on the rounded means, multiplies them in blocks small enough that
doubles hold the products without rounding, and Spark adds the tasks' integers; what the rounding of the
means leaves is taken off as a fraction of integers.  The covariance therefore depends neither on the partitions nor on their order.

The eigenvectors start in float32.  Ogita-Aishima iterations then correct all of them at once by matrix
products, first in doubles, then in extended precision, each about squaring the error.  Where eigenvalues lie closer together
than the error bound, the iteration cannot tell their vectors apart: such a cluster is solved by itself, as the small
matrix of the covariance, less the cluster's mean eigenvalue, in the cluster's own subspace.

Only sums and products of dims or dims * dims numbers reach the driver, never vectors.  A task adds
dims * (dims + 1) / 2 rows to the shuffle of the products.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped; of vectors of
several lengths the commonest length is taken, of equally common ones the longest; a null vec_id stays null and repeated rows
all stay; components whose eigenvalue is nothing but rounding have no whitened value; a table of one distinct vector has no
explained share either; identity_error is taken over the components that have values, null if none has; a deviation
beyond a long is null; an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import write_table

#: Exact integers travel as three limbs of this many bits, since sums of squares outgrow a long.
LIMB = 60
#: Rounds of refinement in each precision that may pass without halving the error; most rounds double the right digits.
ROUNDS = 3
#: Eigenvalues closer than so many error bounds form a cluster.
FAR = 100
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# vectors and their integers


def sound_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, embedding as doubles) of the rows that take part, and their length."""
    sound = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    commonest = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = commonest["dims"] if commonest else 0
    return rows.where(F.size("embedding") == dims), dims


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    return np.clip(values, -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """One key for each distinct vector, in the narrowest integers that hold it."""
    width = np.select([np.abs(x + (x < 0)).max(axis=1) < 2**15, np.abs(x + (x < 0)).max(axis=1) < 2**31], [2, 4], 8)
    return list({bytes([w]) + row.tobytes() for w in (2, 4, 8) for row in np.unique(x[width == w], axis=0).astype(f"<i{w}")})


def _unpacked(keys: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(keys), dims), np.int64)
    for w in (2, 4, 8):
        at = [i for i, k in enumerate(keys) if k[0] == w]
        if at:
            out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at), f"<i{w}").reshape(-1, dims)
    return out


def distinct_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """(key): each distinct integer vector once; repeats within a batch are dropped before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_packed(_integers(batch.column("embedding"), dims)), pa.binary())], names=["key"])

    return write_table(rows.select("embedding").mapInArrow(run, "key binary").distinct(), "fit")


# exact sums


def _limbs(value: int) -> tuple[int, int, int]:
    high, low = divmod(value, 1 << LIMB)
    high, middle = divmod(high, 1 << LIMB)
    return low, middle, high


def _summed(fit: DataFrame, dims: int, count: Callable[[np.ndarray], dict[tuple[int, int], int]]) -> dict[tuple[int, int], int]:
    """The sums over all tasks of the exact integers that count finds in a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            if batch.num_rows:
                for k, v in count(_unpacked(batch.column("key").to_pylist(), dims)).items():
                    total[k] = total.get(k, 0) + v
        rows = [(*k, *_limbs(v)) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names=["i", "j", "low", "middle", "high"])

    parts = fit.mapInArrow(run, "i long, j long, low long, middle long, high long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "middle", "high")])
    return {(r.i, r.j): int(r.low) + (int(r.middle) << LIMB) + (int(r.high) << 2 * LIMB) for r in sums.collect()}


def _first_moments(x: np.ndarray) -> dict[tuple[int, int], int]:
    whole = x.sum(axis=0) if np.abs(x.astype(np.float64)).max() * len(x) < 2**62 else x.astype(object).sum(axis=0)
    return {(-1, -1): len(x)} | {(i, -1): int(v) for i, v in enumerate(whole)}


def _second_moments(centre: list[int]) -> Callable[[np.ndarray], dict[tuple[int, int], int]]:
    def count(x: np.ndarray) -> dict[tuple[int, int], int]:
        y = x - np.array(centre, object) if max(map(abs, centre)) > 2**61 or np.abs(x.astype(np.float64)).max() > 2**61 else x - np.array(centre, np.int64)
        most = int(np.abs(y).max())
        if most >= 2**26:
            wide = y.astype(object)
            total = wide.T @ wide
        else:
            step = min(2**53 // max(1, most * most), len(y))
            blocks = [y[i : i + step].astype(np.float64) for i in range(0, len(y), step)]
            total = sum((b.T @ b).astype(np.int64).astype(object) for b in blocks)
        return {(i, j): int(total[i, j]) for i in range(len(centre)) for j in range(i, len(centre))}

    return count


def covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the covariance in extended precision; each entry is an exact fraction, rounded once."""
    first = _summed(fit, dims, _first_moments)
    n, sums = first[-1, -1], [first[i, -1] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    second = _summed(fit, dims, _second_moments(centre))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    out = np.zeros((dims, dims), np.longdouble)
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = np.longdouble(n * second[i, j] - rest[i] * rest[j]) / np.longdouble(n * n)
    return n, sums, out


# eigenvectors


def _cluster_bounds(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Ranges of two or more neighbours, of rising values, that lie within gap of the next."""
    cuts = [0, *(np.flatnonzero(np.diff(values) > gap) + 1), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]


def _values(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """What x leaves of the identity, a seen through x, the eigenvalues it gives, and how far off these may be."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    value = np.diag(s) / (1 - np.diag(r))
    return r, s, value, 2 * float(np.linalg.norm((s - np.diag(value)).astype(np.float64)) + np.linalg.norm(a.astype(np.float64)) * np.linalg.norm(r.astype(np.float64)))


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One Ogita-Aishima step: better vectors, by rising eigenvalue, and the error bound of those given.

    Pairs whose gap is not far above the bound are only made orthogonal, and then solved as clusters.
    """
    r, s, value, error = _values(a, x)
    gap = value[None, :] - value[:, None]
    apart = np.abs(gap) > FAR * error
    e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
    order = np.argsort(value)
    value, x = value[order], (x + x @ e)[:, order]
    for i, j in _cluster_bounds(value, FAR * error):
        x[:, i:j] = _cluster_solved(a, x[:, i:j], value[i:j])
    return x, error


def _orthonormal(x: np.ndarray) -> np.ndarray:
    return x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2


def _cluster_solved(a: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The vectors of a cluster turned within their subspace to its own eigenvectors.

    The mean eigenvalue is taken off first and the rest scaled up, so that float64 resolves the differences within the cluster.
    """
    x = _orthonormal(_orthonormal(x))
    small = x.T @ (a @ x - value.mean() * x)
    small = (small + small.T) / 2
    size = np.abs(small).max()
    return x if size == 0 else _orthonormal(x @ np.linalg.eigh((small / size).astype(np.float64))[1].astype(x.dtype))


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit vectors as columns, of a symmetric matrix, in extended precision.

    The first entry of a vector that is largest by size is positive.
    """
    size = np.abs(matrix).max() or np.longdouble(1)
    a = matrix / size
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        a_now, x = a.astype(kind), x.astype(kind)
        best, tries = (np.inf, x), 0
        while best[0] > 8 * len(a) * np.finfo(kind).eps and tries < ROUNDS:
            after, error = _corrected(a_now, x)
            best, tries = ((error, x), 0) if error < best[0] / 2 else (best, tries + 1)
            x = after
        x = best[1]
    value = _values(a, x)[2]
    order = np.argsort(value)
    value, x = value[order], x[:, order]
    value, x = value[::-1] * size, x[:, ::-1] / np.sqrt((x[:, ::-1] ** 2).sum(axis=0))
    signs = np.sign(x[np.abs(x.astype(np.float64)).argmax(axis=0), np.arange(len(x))])
    return value, x * np.where(signs == 0, 1, signs)


# the result


def _identity_error(fit: DataFrame, dims: int, mean: np.ndarray, turn: np.ndarray) -> float | None:
    """How far the covariance of the fit list's whitened vectors is from the identity, measured on them."""
    k = turn.shape[1]
    if not k:
        return None
    names = [f"m{i}" for i in range(k)] + [f"p{i}_{j}" for i in range(k) for j in range(i, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = (_unpacked(batch.column("key").to_pylist(), dims) - mean) @ turn
                values = [w[:, i].sum() for i in range(k)] + [w[:, i] @ w[:, j] for i in range(k) for j in range(i, k)]
                yield pa.RecordBatch.from_arrays([pa.array([len(w)], pa.int64()), *[pa.array([v], pa.float64()) for v in values]], names=["n", *names])

    found = fit.mapInArrow(run, "n long, " + ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in ("n", *names)]).first()
    # the vectors were centred before they were multiplied; what is left of their mean is rounding
    gaps = [found[f"p{i}_{j}"] / found["n"] - found[f"m{i}"] / found["n"] * (found[f"m{j}"] / found["n"]) - (i == j) for i in range(k) for j in range(i, k)]
    return max(map(abs, gaps))


def whitened(vectors: DataFrame, components: int = 4) -> DataFrame:
    """A row per sound vector and component, numbered from 1 by falling eigenvalue: see OUT.

    n is the number of distinct vectors, deviation the exact sum over dimensions of (n * x - S)^2, whitened the projection of
    x - S / n over the root of the eigenvalue, explained the eigenvalue's share, identity_error one value for all rows.
    """
    rows, dims = sound_vectors(vectors)
    if not dims:
        return vectors.sparkSession.createDataFrame([], OUT)
    fit = distinct_vectors(rows, dims)
    n, sums, matrix = covariance(fit, dims)
    value, vector = eigenvectors(matrix)
    k, trace = min(components, dims), np.trace(matrix)
    some = [bool(value[i] > trace * dims * np.longdouble(2) ** -60) for i in range(k)]
    mean = np.array([np.longdouble(s) / np.longdouble(n) for s in sums]).astype(np.float64)
    turn = np.stack([(vector[:, i] / np.sqrt(value[i])).astype(np.float64) if some[i] else np.zeros(dims) for i in range(k)], axis=1)
    explained = [float(max(value[i], 0) / trace) if trace > 0 else None for i in range(k)]
    error = _identity_error(fit, dims, mean, turn[:, [i for i in range(k) if some[i]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column("embedding"), dims)
            most = (float(np.abs(x.astype(np.float64)).max()) * n + max(map(abs, sums))) ** 2 * dims
            if most < 2**62:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
            else:
                deviation = [v if v < 2**63 else None for v in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]
            w, m = (x - mean) @ turn, len(x)
            columns = [
                pa.array(np.repeat(np.arange(m), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(np.array(deviation, object), k), pa.int64()),
                pa.array(w.ravel(), mask=np.tile(~np.array(some), m)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
            ]
            columns[0] = batch.column("vec_id").take(columns[0])
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, OUT)
