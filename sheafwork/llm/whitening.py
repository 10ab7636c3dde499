"""Whitening of embeddings by an incremental eigendecomposition.

Each partition of the different vectors builds the spectrum of its own scatter by centred rank-one
updates (``spectra.py``).  Spectra are combined a few at a time, round by round, again by rank-one
updates, until one is left.  Its leading eigenvectors, and some more as a guard, are then refined against
the data: one pass over all partitions multiplies them by the covariance, a Rayleigh-Ritz step turns them
to the best eigenvectors in their span, and what is left over is measured; where it is above the
tolerance the products are the next span.  No task holds more than a batch of rows and a few matrices
of the vectors' dimension.

Vectors are whole numbers here, ``floor(64 * entry) + 1000000``; sums of them, and so the mean and the
deviations, are exact.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sheafwork.llm.spectra import EPS, Spectrum
from sheafwork.llm.tables import partitions, shared

SCALE, SHIFT = 64, 1_000_000
#: Components of a result at most.
COMPONENTS = 16
#: Eigenvectors that are refined beside those wanted.
GUARD = 8
#: Spectra or matrices that are combined in a task.
FAN_IN = 16
#: Refinement ends when no product leaves its span by more than this share of the largest eigenvalue.
TOLERANCE = 2e-14
ROUNDS = 6
#: Entries and sums beyond this are an error: they would not be exact.
EXACT = 1 << 62


class Whitening(NamedTuple):
    """What was fitted: vectors, exact sums, eigenvalues (falling), eigenvectors (columns) and the trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector has no null and no entry that is not finite.

    Rows whose vector is empty, or not of the dimension most vectors have (of several the largest),
    are left out as well.
    """
    entry = lambda v: v.cast("double")
    finite = lambda v: v.isNotNull() & ~F.isnan(entry(v)) & (F.abs(entry(v)) < float("inf"))
    given = rows.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector_column}`").alias("vector"))
    good = given.where((F.size("vector") > 0) & F.forall("vector", finite))
    sizes = good.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    dimension = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).select("d").first()
    x = F.transform("vector", lambda v: F.floor(entry(v) * SCALE).cast("bigint") + SHIFT)
    return good.where(F.size("vector") == (dimension[0] if dimension else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors (rows, size) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(**values: np.ndarray) -> pa.RecordBatch:
    """One row of arrays of numbers."""
    return pa.record_batch([pa.array([v.ravel()]) for v in values.values()], names=list(values))


def _combined(rows: DataFrame, combine: Callable[[pa.Table], pa.RecordBatch], label: str) -> DataFrame:
    """One row from those of many partitions (part): ``combine`` makes one of FAN_IN rows at most."""
    rows, turn = shared(rows, label), 0
    while rows.count() > 1:

        def one(key: tuple, table: pa.Table) -> pa.Table:
            made = combine(table.drop_columns(["part"]))
            return pa.Table.from_batches([made]).add_column(0, "part", pa.array([key[0].as_py()], pa.int64()))

        groups = rows.groupBy(F.expr(f"part div {FAN_IN}").alias("_group"))
        rows, turn = shared(groups.applyInArrow(one, rows.schema), f"{label}-{turn}"), turn + 1
    return rows.drop("part")


def _per_partition(rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """One row of arrays from each partition that has rows; ``make`` gets its matrices (rows, size)."""

    def run(batches):
        matrices = (_matrix(b.column(0), len(b.column(0)[0])) for b in batches if b.num_rows)
        first = next(matrices, None)
        if first is not None:
            yield make(_chain(first, matrices))

    made = rows.mapInArrow(run, schema)
    return made.select(F.spark_partition_id().cast("bigint").alias("part"), "*")


def _chain(first, rest):
    yield first
    yield from rest


_SPECTRUM = "n array<bigint>, sums array<bigint>, mean array<double>, values array<double>, vectors array<double>"


def _spectrum_row(spectrum: Spectrum, sums: np.ndarray) -> pa.RecordBatch:
    return _packed(
        n=np.array([spectrum.n]), sums=sums, mean=spectrum.mean, values=spectrum.values, vectors=spectrum.vectors
    )


def partition_spectra(vectors: DataFrame) -> DataFrame:
    """The spectrum and the exact sums of each partition of vectors (x)."""

    def build(matrices):
        spectrum = sums = None
        for x in matrices:
            spectrum = spectrum or Spectrum(x.shape[1])
            if np.abs(x).max() > EXACT // max(1, spectrum.n + len(x)):
                raise OverflowError("sums of these vectors are not exact in 64 bits")
            sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
            for vector in (x - SHIFT).astype(np.float64):
                spectrum.add(vector)
        return _spectrum_row(spectrum, sums)

    return _per_partition(vectors, build, _SPECTRUM)


def _merge_spectra(table: pa.Table) -> pa.RecordBatch:
    whole = sums = None
    for row in table.to_pylist():
        one = Spectrum(len(row["mean"]))
        one.n, one.mean, one.values = row["n"][0], np.array(row["mean"]), np.array(row["values"])
        one.vectors = np.array(row["vectors"]).reshape(len(one.mean), -1)
        if whole is None:
            whole, sums = one, row["sums"]
            continue
        sums = [a + b for a, b in zip(sums, row["sums"])]
        whole.merge(one)
    if max(map(abs, sums)) > EXACT:
        raise OverflowError("sums of these vectors are not exact in 64 bits")
    return _spectrum_row(whole, np.array(sums, np.int64))


def _add_rows(table: pa.Table) -> pa.RecordBatch:
    columns = {name: np.array(table.column(name).to_pylist()).sum(axis=0) for name in table.column_names}
    return _packed(**columns)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once."""
    return (n * x - sums) / n


def _refined(vectors: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray, wanted: int):
    """Eigenvalues and eigenvectors near ``basis``, and the trace, by Rayleigh-Ritz steps over the data."""
    for _ in range(ROUNDS):
        span = basis

        def multiply(matrices, span=span):
            product, squares = 0.0, 0.0
            for x in matrices:
                y = _centred(x, n, sums)
                product = product + y.T @ (y @ span)
                squares += float((y * y).sum())
            return _packed(product=product, squares=np.array([squares]))

        made = _per_partition(vectors, multiply, "product array<double>, squares array<double>")
        product, squares = _combined(made, _add_rows, "products").first()
        product, trace = np.array(product).reshape(span.shape) / n, squares[0] / n
        ritz = span.T @ product
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, product = span @ turn, product @ turn
        rest = np.abs(product - basis * values)[:, :wanted].max(initial=0.0)
        if rest <= TOLERANCE * max(values[0], 0.0) or not values[0] > 0:
            break
        basis = np.linalg.qr(product)[0]
        # The last Ritz vectors are kept; another turn refines them further.
        best = span @ turn
    else:
        basis = best
    return values, basis, trace


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit to the different vectors (x); None where there are none.

    Directions without variance are no components.  Between equal eigenvalues any orthonormal
    eigenvectors may come out, the same for all rows.
    """
    spark = vectors.sparkSession
    distinct = vectors.select("x").distinct().repartition(partitions(spark), "x")
    distinct = shared(distinct, "distinct-vectors")
    spectrum = _combined(partition_spectra(distinct), _merge_spectra, "spectra").first()
    if spectrum is None:
        return None
    n, sums, size = spectrum.n[0], np.array(spectrum.sums, np.int64), len(spectrum.sums)
    _checked(n, sums)
    wanted = min(components, size)
    basis = np.array(spectrum["vectors"]).reshape(size, size)[:, ::-1][:, : wanted + GUARD]
    values, basis, trace = _refined(distinct, n, sums, basis, wanted)
    kept = int((values[:wanted] > size * EPS * max(values[0], 0.0)).sum())
    values, basis = values[:kept], basis[:, :kept]
    return Whitening(n, sums, values, basis, trace, _identity_error(distinct, n, sums, values, basis))


def _checked(n: int, sums: np.ndarray) -> None:
    if int(np.abs(sums).max(initial=0)) > EXACT // max(n, 1) * n:
        raise OverflowError("n times these vectors is not exact in 64 bits")


def _identity_error(vectors: DataFrame, n: int, sums: np.ndarray, values: np.ndarray, basis: np.ndarray) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, over all of them."""
    if not len(values):
        return 0.0
    project = basis / np.sqrt(values)

    def moments(matrices):
        sums_, squares = 0.0, 0.0
        for x in matrices:
            w = _centred(x, n, sums) @ project
            sums_, squares = sums_ + w.sum(axis=0), squares + w.T @ w
        return _packed(sums=sums_, squares=squares)

    made = _per_partition(vectors, moments, "sums array<double>, squares array<double>")
    total, squares = _combined(made, _add_rows, "moments").first()
    mean = np.array(total) / n
    covariance = np.array(squares).reshape(len(values), -1) / n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(values))).max())


_RESULT = (
    "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row (vec_id, x).

    ``deviation`` is the exact sum of (n * x - sums)^2; one beyond 64 bits is an error.
    """
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, {_RESULT}"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    project = model.vectors / np.sqrt(model.values)
    shares = model.values / model.trace
    n, sums, error = model.n, model.sums, model.identity_error

    def transform(batches):
        many = len(shares)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), len(sums))
            if int(np.abs(x).max()) > EXACT // n:
                raise OverflowError("n times these vectors is not exact in 64 bits")
            away = n * x - sums
            if (away.astype(np.float64) ** 2).sum(axis=1).max() > EXACT:
                raise OverflowError("deviations are beyond 64 bits")
            whitened = (away / n) @ project
            count = len(x) * many
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), many))),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, n)),
                    pa.array(np.repeat((away * away).sum(axis=1), many)),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(shares, len(x))),
                    pa.array(np.full(count, error)),
                ],
                names=["vec_id", *(c.split()[0] for c in _RESULT.split(", "))],
            )

    return rows.select("vec_id", "x").mapInArrow(transform, schema)


def whiten_embeddings(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of all rows with a whole vector; rows that repeat are whitened each.

    Rows with a null vector or an entry that is null or not finite are dropped.  An empty table, and
    vectors that are all equal, give no rows.
    """
    kept = shared(whole_vectors(rows), "whole-vectors")
    return whiten(kept, fit_whitening(kept, components))
