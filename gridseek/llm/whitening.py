"""Embedding whitening by matrix-free block subspace iteration (operator 12).

Entries become whole numbers, so that counts, sums and deviations are exact in any order of the rows. The
covariance is never formed: a pass over the rows computes ``X'(XQ)`` of the centred rows ``X`` and an
orthonormal block ``Q``, sums it in each task and then by dimension. After a pass the driver, which holds
``dimensions x columns`` numbers at most, takes the Rayleigh-Ritz values and vectors of the span of the blocks
so far and their residuals. The next block is what the pass gave beyond that span, by QR. Passes end once the
residuals of all components are at most ``TOLERANCE`` of the largest eigenvalue; a span that has grown to
``SPAN`` columns starts again from its best vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseek.plans.durable import discard, materialize

#: Components, further columns of a block, columns of a span, bound of the residuals and passes at most.
K, MORE, SPAN, TOLERANCE, PASSES, SEED = 8, 8, 512, 1e-13, 500, 3
#: An entry becomes ``floor(SCALE * entry) + SHIFT``; entries from ``TOO_LARGE`` on have no such number.
SCALE, SHIFT, TOO_LARGE = 1024, 100_000, 2.0**52
#: Share of the largest eigenvalue below which a component has no variance.
NOTHING = 1e-12
_EXACT = 1 << 62


@dataclass(frozen=True)
class Fit:
    """Rows, exact sums and largest deviation (times rows) of the fit list; components as columns, and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    largest: int
    trace: float
    components: np.ndarray
    values: np.ndarray
    identity_error: float = 0.0


def usable(vec: str):
    """Vectors that take part: not null and without null, non-finite or too large entries."""
    ok = F.forall(F.col(vec), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < TOO_LARGE))
    return F.coalesce(F.col(vec).isNotNull() & ok, F.lit(False))


def whole_entries(vec: str):
    """The entries of a vector as whole numbers."""
    return F.transform(F.col(vec), lambda c: (F.floor(F.lit(float(SCALE)) * c.cast("double")) + SHIFT).cast("long"))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches and their rows as matrices; shorter vectors are padded by the number of a zero."""
    for batch in batches:
        lists = batch.column("x")
        sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        flat = np.asarray(lists.flatten(), dtype=np.int64)
        if (sizes == dim).all():
            yield batch, flat.reshape(len(sizes), dim)
        elif len(sizes):
            out = np.full((len(sizes), dim), SHIFT, dtype=np.int64)
            out[np.arange(dim)[None, :] < sizes[:, None]] = flat
            yield batch, out


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums`` exactly: in machine words where they are wide enough, else in Python's numbers."""
    wide = max(n * (int(np.abs(x).max(initial=0)) + 1), max(map(abs, sums), default=0)) * 2 >= _EXACT
    kind = object if wide else np.int64
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _totals(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    n, total, low, high = 0, [0] * dim, None, None
    for _, x in _blocks(batches, dim):
        n += len(x)
        if len(x):
            part = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < _EXACT else x.astype(object).sum(axis=0)
            total = [a + int(b) for a, b in zip(total, part)]
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if n:
        yield pa.RecordBatch.from_pydict({"d": list(range(dim)), "n": [n] * dim, "s": [str(t) for t in total], "low": low.tolist(), "high": high.tolist()})


def _squares(batches: Iterator[pa.RecordBatch], dim: int, n: int, sums: tuple[int, ...], largest: int) -> Iterator[pa.RecordBatch]:
    total = 0
    for _, x in _blocks(batches, dim):
        total += sum(map(int, _square_sums(_deviations(x, n, sums), dim, largest)))
    yield pa.RecordBatch.from_pydict({"s": [str(total)]})


def _square_sums(deviations: np.ndarray, dim: int, largest: int) -> np.ndarray:
    if dim * largest * largest >= _EXACT:
        deviations = deviations.astype(object)
    return (deviations * deviations).sum(axis=1)


def _product(batches: Iterator[pa.RecordBatch], dim: int, made: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sum over a task's rows of the outer products of what ``made`` gives for each row, as one row a dimension."""
    total = None
    for _, x in _blocks(batches, dim):
        left, right = made(x)
        total = left.T @ right + (0.0 if total is None else total)
    if total is not None:
        rows, columns = total.shape
        data = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * columns, pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), data], ["d", "y"])


def _iterated(x: np.ndarray, n: int, sums: tuple[int, ...], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = _centred(x, n, sums)
    return rows, rows @ q


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return _centred(x, fit.n, fit.sums) @ fit.components / np.sqrt(fit.values)


def _twice(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    w = _whitened(x, fit)
    return w, w


def _summed(rows: DataFrame, dim: int, columns: int, made) -> np.ndarray:
    """The sum over all rows: partial sums in each task, then by dimension; only the result comes to the driver."""
    parts = rows.select("x").mapInArrow(partial(_product, dim=dim, made=made), "d long, y array<double>")
    added = parts.groupBy("d").agg(*[F.sum(F.col("y")[k]).alias(f"y{k}") for k in range(columns)])
    return np.array([list(r)[1:] for r in sorted(added.collect())], dtype=np.float64).reshape(-1, columns)


def subspace(apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int = K, more: int = MORE, span: int = SPAN, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric non-negative matrix and their unit vectors as columns.

    ``apply`` multiplies a block of columns by the matrix, in one pass over the data.
    """
    k = min(k, dim)
    width, draw = min(dim, k + more), np.random.default_rng(SEED)
    span = min(dim, max(span, 3 * width))
    block = np.linalg.qr(draw.standard_normal((dim, width)))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(PASSES):
        basis, image = np.hstack([basis, block]), np.hstack([image, apply(block)])
        inner = basis.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        vectors, moved = basis @ turns, image @ turns
        residuals = np.linalg.norm(moved[:, :k] - vectors[:, :k] * values[:k], axis=0)
        if (residuals <= tolerance * max(values[0], 0.0)).all() or basis.shape[1] == dim:
            return np.maximum(values[:k], 0.0), vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
        new = moved[:, :width] - vectors[:, :width] * values[:width]  # what the pass gave beyond the span
        if basis.shape[1] + width > span < dim:
            basis, image = vectors[:, : 2 * k], moved[:, : 2 * k]
        new = new / np.maximum(np.linalg.norm(new, axis=0), np.finfo(float).tiny)
        for _ in range(2):  # twice, as the first leaves rounding errors along the span
            new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        block = new[:, : min(width, dim - basis.shape[1])]
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    raise RuntimeError(f"no {k} certified components in {PASSES} passes")


def fit_whitening(rows: DataFrame, k: int = K) -> Fit | None:
    """Fit on all rows of a table with a column ``x`` of whole numbers; None without rows or dimensions."""
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return None
    parts = rows.select("x").mapInArrow(partial(_totals, dim=dim), "d long, n long, s string, low long, high long")
    exact = F.sum(F.col("s").cast("decimal(38,0)"))
    told = sorted(parts.groupBy("d").agg(F.sum("n"), exact, F.min("low"), F.max("high")).collect())
    n, sums = told[0][1], tuple(int(r[2]) for r in told)
    largest = max(max(n * r[4] - s, s - n * r[3]) for r, s in zip(told, sums))
    squares = rows.select("x").mapInArrow(partial(_squares, dim=dim, n=n, sums=sums, largest=largest), "s string")
    square = int(squares.agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0])
    passes = lambda q: _summed(rows, dim, q.shape[1], partial(_iterated, n=n, sums=sums, q=q)) / n
    values, components = subspace(passes, dim, k)
    held = values > NOTHING * max(values[0], 0.0)
    fit = Fit(n, sums, largest, square / n**3, components[:, held], values[held])
    if not held.any():
        return fit
    found = _summed(rows, dim, int(held.sum()), partial(_twice, fit=fit)) / n
    return Fit(fit.n, fit.sums, fit.largest, fit.trace, fit.components, fit.values, float(np.abs(found - np.eye(len(found))).max()))


def _rows_out(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    dim = len(fit.sums)
    for batch, x in _blocks(batches, dim):
        squares = _square_sums(_deviations(x, fit.n, fit.sums), dim, fit.largest)
        w = _whitened(x, fit)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([str(s) for s in squares], pa.string()), lists], ["id", "deviation", "whitened"])


def whole_rows(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, x)`` of the rows that take part, as a written table."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(usable("vec"))
    return materialize(rows.select("id", whole_entries("vec").alias("x")))


def whiten(rows: DataFrame, fit: Fit | None) -> DataFrame:
    """``(id, deviation decimal(38,0), whitened array<double>)`` of every row of ``(id, x)``."""
    kind = rows.schema["id"].dataType.simpleString()
    if fit is None:
        return rows.select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    out = rows.mapInArrow(partial(_rows_out, fit=fit), f"id {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whitening_report(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each remaining vector and component: ``(id, component, n, deviation, whitened, explained, identity_error)``.

    Vectors that are null or hold null, non-finite or too large entries take no part; shorter ones count as
    padded by zeros; repeated rows count each and null ids stay. Components without variance have no rows, so
    that one vector alone, or an empty table, gives none; of equal eigenvalues any vectors of their space may be
    taken. A deviation beyond 64 bits is an error here, not in :func:`whiten`. Other columns are ignored.
    """
    rows = whole_rows(vectors, id_col, vec_col)
    fit = fit_whitening(rows, k)
    if fit is None or not len(fit.values):
        discard(rows)
        schema = f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    shares = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values])
    each = whiten(rows, fit).select("id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
