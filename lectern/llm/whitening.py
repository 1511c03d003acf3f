"""Whitened embeddings from covariances by polarisation.

Entries become integers, so every sum is exact. With ``z = n x - S`` (the centred value times the number of vectors) each
task adds the squares ``z_i ** 2`` of every dimension and ``(z_i + z_j) ** 2`` of every sum of two dimensions; nothing else
is multiplied. Half the difference of the sums, ``var(i + j) - var(i) - var(j)``, is the covariance of i and j. The matrix
is put together from integers, rounded once, and its eigenvectors whiten the vectors.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lectern.llm.common import cut_lineage

#: Steps that one unit is divided in, and what is added so that no usual entry is negative.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Vectors whose squares are added at once: sums of that many stay below 2**63.
ROWS = 1024
#: Integers of any size travel as digits of 40 bits, which Spark adds column by column.
DIGIT, DIGITS = 40, 6
#: Values below 2**47 are split in two parts of 24 bits, so that squares and their sums fit 64 bits.
HALF, SPLIT_LIMIT = 24, 1 << 47

_DIGIT_COLUMNS = ", ".join(f"d{k} bigint" for k in range(DIGITS))
Batches = Iterator[pa.RecordBatch]


def _digits(value: int) -> list[int]:
    out = []
    for _ in range(DIGITS - 1):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value]


def _number(row) -> int:
    return sum(row[f"d{k}"] << (DIGIT * k) for k in range(DIGITS))


def _digit_sums() -> list:
    return [F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)]


def _digit_batch(keys: dict[str, pa.Array], values: list[int]) -> pa.RecordBatch:
    columns = list(zip(*map(_digits, values), strict=True))
    return pa.RecordBatch.from_arrays([*keys.values(), *[pa.array(c, pa.int64()) for c in columns]],
                                      names=[*keys, *[f"d{k}" for k in range(DIGITS)]])


def steps(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) of the usable vectors of a batch, for each length that occurs.

    Unusable are null and empty vectors, those with a null or non-finite entry, and those with one that becomes no long.
    """
    vectors = batch.column("embedding").cast(pa.large_list(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
        scaled = np.floor(SCALE * flat)
        good = (np.abs(scaled) < 2.0**62).all(axis=1)  # false for NaN, which nulls are by now
        if good.any():
            yield rows[good], scaled[good].astype(np.int64) + OFFSET


def _add_up(batches: Batches) -> Batches:
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in steps(batch):
            n, sums = totals.get(x.shape[1], (0, 0))
            exact = ((x >> 32).sum(axis=0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            totals[x.shape[1]] = [n + len(x), sums + exact]
    for length, (n, sums) in totals.items():
        yield _digit_batch({"length": pa.array([length] * length, pa.int32()), "i": pa.array(range(length), pa.int32()),
                            "n": pa.array([n] * length, pa.int64())}, sums.tolist())


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S`` exactly: 64-bit integers where they suffice, Python's elsewhere."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if largest < 1 << 62:
        z = x * n - np.array(sums, dtype=np.int64)
        if np.abs(z).max(initial=0) < SPLIT_LIMIT:
            return z
    return x.astype(object) * n - np.array(sums, dtype=object)


def square_sums(z: np.ndarray, axis: int, plus: np.ndarray | None = None) -> np.ndarray:
    """Exact sums of ``(z + plus) ** 2`` along an axis, as Python integers."""
    if z.dtype == object:
        w = z if plus is None else z + plus
        return (w * w).sum(axis=axis)
    high, low = z >> HALF, z & ((1 << HALF) - 1)
    if plus is not None:
        high, low = high + (plus >> HALF), low + (plus & ((1 << HALF) - 1))
    kept = "ij,ij->" + "ij"[1 - axis]
    return ((np.einsum(kept, high, high).astype(object) << 2 * HALF) + (np.einsum(kept, high, low).astype(object) << HALF + 1)
            + np.einsum(kept, low, low).astype(object))


def _add_squares(length: int, n: int, sums: list[int]):
    """Per task one row for each dimension (i, i) and each sum of two dimensions (i, j)."""
    def add(batches: Batches) -> Batches:
        totals = None
        for batch in batches:
            for _, x in (part for part in steps(batch) if part[1].shape[1] == length):
                totals = [0] * length if totals is None else totals
                for at in range(0, len(x), ROWS):
                    z = centred(x[at:at + ROWS], n, sums)
                    singles = square_sums(z, 0)
                    for i in range(length):
                        pairs = square_sums(z[:, i + 1:], 0, z[:, i:i + 1])
                        totals[i] = totals[i] + np.concatenate([singles[i:i + 1], pairs])
        if totals is not None:
            i, j = np.triu_indices(length)
            yield _digit_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())}, np.concatenate(totals).tolist())
    return add


def covariance(squares: dict[tuple[int, int], int], length: int, n: int) -> np.ndarray:
    """The matrix from sums of squares of n-fold centred values: cov(i, j) = (var(i + j) - var(i) - var(j)) / 2."""
    matrix = np.empty((length, length))
    for (i, j), both in squares.items():
        own = both if i == j else both - squares[i, i] - squares[j, j]
        matrix[i, j] = matrix[j, i] = own / (n**3 if i == j else 2 * n**3)
    return matrix


def principal(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their eigenvectors as columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * signs


def _whiten(length: int, n: int, sums: list[int], factors: np.ndarray, live: int):
    def whitened(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for rows, x in steps(batch):
            if x.shape[1] == length:
                z = centred(x, n, sums)
                yield rows, z, (z / n).astype(np.float64) @ factors[:, :live]
    return whitened


def _project(whitened: Callable, missing: int):
    def project(batches: Batches) -> Batches:
        for batch in batches:
            for rows, z, values in whitened(batch):
                deviation = [Decimal(d) if d < 10**38 else None for d in square_sums(z, 1).tolist()]
                filled = [v + [None] * missing for v in values.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), pa.array(deviation, pa.decimal128(38, 0)), pa.array(filled, pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "whitened"])
    return project


def _second_moments(whitened: Callable, live: int):
    def add(batches: Batches) -> Batches:
        first, second = np.zeros(live), np.zeros((live, live))
        for batch in batches:
            for _, _, values in whitened(batch):
                first += values.sum(axis=0)
                second += values.T @ values
        i, j = np.indices((live + 1, live)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.vstack([second, first]).ravel())],
                                         names=["i", "j", "part"])
    return add


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for ``vectors`` (vec_id, embedding).

    Every usable row is fitted and returned with its first ``most`` principal components (all, if there are fewer
    dimensions). ``deviation`` is a decimal, null beyond 38 digits. Null and empty vectors, those with a null or non-finite entry
    or one beyond 2**56 are left out; so are vectors that are not as long as most (ties: the longer), since they lie in
    another space. Ids may be null or repeated: each row counts. A component without variance (as all of equal vectors or
    of one vector) can't be scaled to one: its ``whitened`` is null and ``identity_error`` covers the others, null if there
    is none; ``explained`` is null if nothing varies. An empty table gives no rows, other columns are ignored.

    The driver receives one number for each dimension and pair of dimensions, however many vectors there are; lengths to
    some thousands are meant. Each of three passes reads the vectors; none shuffles more than those numbers per task.
    """
    vectors = vectors.select("vec_id", "embedding")
    lone = vectors.select("embedding")
    sums = cut_lineage(lone.mapInArrow(_add_up, f"length int, i int, n bigint, {_DIGIT_COLUMNS}")
                       .groupBy("length", "i").agg(F.sum("n").alias("n"), *_digit_sums()))
    best = sums.agg(F.max(F.struct("n", "length")).alias("most")).first()["most"]
    if best is None:
        return vectors.where("false").selectExpr(
            "vec_id", "1 AS component", "0L AS n", "cast(0 AS decimal(38,0)) AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    n, length = best["n"], best["length"]
    total = [_number(r) for r in sums.where(F.col("length") == length).orderBy("i").collect()]
    squares = lone.mapInArrow(_add_squares(length, n, total), f"i int, j int, {_DIGIT_COLUMNS}").groupBy("i", "j").agg(*_digit_sums())
    matrix = covariance({(r["i"], r["j"]): _number(r) for r in squares.collect()}, length, n)
    values, axes = principal(matrix, most)
    trace, found = float(np.trace(matrix)), len(values)
    live = int((values > length * np.finfo(float).eps * max(values[0], 0)).sum())
    whitened = _whiten(length, n, total, axes[:, :live] / np.sqrt(values[:live]), live)
    error = None
    if live:
        parts = lone.mapInArrow(_second_moments(whitened, live), "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
        moments = np.zeros((live + 1, live))
        for r in parts.collect():
            moments[r["i"], r["j"]] = r["part"]
        mean = moments[live] / n
        error = float(np.abs(moments[:live] / n - np.outer(mean, mean) - np.eye(live)).max())
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    rows = vectors.mapInArrow(_project(whitened, found - live), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, "
                              "deviation decimal(38,0), whitened array<double>")
    return (rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error")))
