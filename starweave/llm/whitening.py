"""Embedding whitening by spectrum slicing.

A vector's entries become integers x = floor(64 * entry) + 1000000. The fit list holds each distinct x-vector once; from it
come, in two passes of Spark jobs, the exact sums and the covariance V (centred before it is multiplied, divisor n). Tasks
send one row a dimension; the driver sees V only, whose size is the number of dimensions squared, whatever the rows.

`leading` finds the eigenpairs of V one by one, the largest first. The signs of D in an LDLᵀ factorisation of V - shift * I
tell how many eigenvalues lie above the shift (Sylvester); bisection on these counts closes an interval around the k-th
one alone. Rayleigh quotient iteration then converges from inside, cubically; a result outside the interval is refused and
the interval halved again. Vectors are kept orthogonal to those found before, so equal eigenvalues give some orthonormal
basis. Last, counts on both sides of every value certify its number.

Edge cases: null vectors, and vectors with a null, NaN or infinite entry, are dropped. Vectors have `dims` entries, by
default the most frequent length (of equally frequent ones the longest); others are dropped. 64 * entry is held within
+-2^50. Repeated rows each get their rows, but count once in the fit; equal ids are not told apart. An empty table, and one
whose vectors are all equal, have no component, so no rows. Components whose eigenvalue is within
rounding of zero (under 2^13 * d * 2^-52 of the largest diagonal entry, where no four digits of it are sure) are left out. A deviation that no long can hold is null. Other columns are not read by
`components_of`; `Whitening.apply` passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import drop, free_names, materialize, small_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
_LIMIT = float(1 << 50)
_EPS = float(np.finfo(np.float64).eps)


# -- the spectrum of one symmetric matrix


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix are above shift: positive pivots of LDLᵀ with Bunch-Kaufman pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above, alpha = len(a), 0, 0, (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        two = False
        if k + 1 < n:
            below = np.abs(a[k + 1 :, k])
            r = k + 1 + int(below.argmax())
            most, own = below[r - k - 1], abs(a[k, k])
            if own < alpha * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                other = row.max()
                if own * other < alpha * most * most:
                    two = abs(a[r, r]) < alpha * other
                    swap(k + two, r)
        if two:
            above += 1  # such a block has one positive and one negative eigenvalue
            side = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(a[k : k + 2, k : k + 2], side.T)
            k += 2
        else:
            above += a[k, k] > 0
            if a[k, k] != 0:
                side = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(side / a[k, k], side)
            k += 1
    return int(above)


def _polish(v: np.ndarray, inside: tuple[float, float], known: np.ndarray, seed: int, floor: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval; None if it leaves the interval."""
    eye, rho = np.eye(len(v)), sum(inside) / 2
    x = np.random.default_rng(seed).standard_normal(len(v))
    best = None
    for step in range(40):
        try:
            x = np.linalg.solve(v - rho * eye, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            x = np.linalg.solve(v - (rho + floor / 16) * eye, x)
        for _ in range(2):
            x = x - known @ (known.T @ x)
            x = x / np.linalg.norm(x)
        if step < 2:
            continue  # inverse iteration about the middle first
        rho = float(x @ v @ x)
        left = np.linalg.norm(v @ x - rho * x)
        if best is not None and left >= best[2] / 2 and best[2] <= floor:
            break
        if best is None or left < best[2]:
            best = (rho, x, left)
    rho, x, left = best
    return (rho, x) if left <= floor and inside[0] - floor <= rho <= inside[1] + floor else None


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a positive semidefinite matrix: the `most` largest above rounding."""
    d = len(v)
    size = float(np.max(np.diag(v), initial=0.0))
    if not size > 0:
        return np.zeros(0), np.zeros((d, 0))
    v = v / size
    floor = 32 * d * _EPS
    counts = {-floor: d, float(np.abs(v).sum(axis=1).max()) * (1 + 1e-6) + floor: 0}  # all eigenvalues are between
    values, vectors = [], np.zeros((d, 0))

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v, shift)
        return counts[shift]

    for k in range(1, min(most, d) + 1):
        if count(256 * floor) < k:
            break
        found = None
        while found is None:
            lo, hi = max(s for s, c in counts.items() if c >= k), min(s for s, c in counts.items() if c < k)
            alone, tight = counts[lo] == k and counts[hi] == k - 1, hi - lo <= floor
            if alone or tight:
                found = _polish(v, (lo, hi), vectors, k, floor)
                if tight and found is None:
                    found = _polish(v, (lo - floor, hi + floor), vectors, k + most, 16 * floor)
                    if found is None:
                        raise ArithmeticError(f"eigenvalue {k} between {lo} and {hi} was not resolved")
            if found is None:
                count((lo + hi) / 2)
        values.append(found[0])
        x = found[1]
        vectors = np.column_stack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    for k, e in enumerate(values, 1):
        if not (inertia(v, e - 2 * floor) >= k > inertia(v, e + 2 * floor)):
            raise ArithmeticError(f"eigenvalue {k} is not number {k} of the spectrum")
    return np.array(values) * size, vectors


# -- fit and use


def integers(vector: Column) -> Column:
    """x of a vector column."""
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-_LIMIT)), F.lit(_LIMIT))
    return F.transform(vector, lambda c: F.floor(scaled(c)).cast("long") + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of one task by dimension, as decimals; dimension -1 counts the vectors."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            n += batch.num_rows
            for part in range(0, batch.num_rows, 4096):
                own = _matrix(batch.column(0).slice(part, 4096)).sum(axis=0).astype(object)
                total = own if total is None else total + own
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([str(n), *map(str, total)])], names=["dim", "total"])


def _products(centre, project):
    """One task's sum of products of centred vectors (projected first, if asked), a row a dimension; row -1 has their sums."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = centre.value
        total = sums = None
        for batch in batches:
            if batch.num_rows:
                z = (_matrix(batch.column(0)) - whole).astype(float) - rest
                z = z if project is None else z @ project.value
                total, sums = (z.T @ z, z.sum(axis=0)) if total is None else (total + z.T @ z, sums + z.sum(axis=0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([sums.tolist(), *total.tolist()], pa.list_(pa.float64()))], names=["dim", "row"])

    return of


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, row in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), strict=True):
            rows[k] = rows[k] + row if k in rows else row.copy()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tolist() for r in rows.values()], pa.list_(pa.float64()))], names=["dim", "row"])


def _covariance(fit: DataFrame, n: int, centre, project=None) -> np.ndarray:
    """Of the centred (and projected) vectors. Each task sends d rows of d; they meet by row, and the driver gets d rows."""
    schema = "dim int, row array<double>"
    rows = fit.mapInArrow(_products(centre, project), schema).repartition("dim").mapInArrow(_added, schema).collect()
    by = {r["dim"]: np.array(r["row"]) for r in rows}
    mean = by[-1] / n  # what rounding left of the centre, zero to the last bits
    v = np.array([by[k] for k in range(len(mean))]) / n - np.outer(mean, mean)
    return (v + v.T) / 2


@dataclass
class Whitening:
    n: int
    dims: int
    sums: list[int]  # exact, of x
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    identity_error: float

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        return _centre(self.sums, self.n)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def apply(self, df: DataFrame, vector_col: str = "embedding", out_col: str = "whitened") -> DataFrame:
        """df's usable rows with one more column, the whitened vector (array<double>); JVM-side, for use in a plan."""
        (z,) = free_names([*df.columns, out_col], "z")
        whole, rest = self.centre
        rows = df.where(usable(F.col(vector_col)) & (F.size(vector_col) == self.dims))
        mean = F.array(*(F.struct(F.lit(int(w)).alias("w"), F.lit(float(r)).alias("r")) for w, r in zip(whole, rest, strict=True)))
        rows = rows.withColumn(z, F.zip_with(integers(F.col(vector_col)), mean, lambda x, m: (x - m["w"]).cast("double") - m["r"]))
        scaled = self.vectors / np.sqrt(self.values)
        dot = lambda weights: F.aggregate(F.zip_with(F.col(z), F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
        return rows.withColumn(out_col, F.array(*(dot(scaled[:, k]) for k in range(len(self.values)))).cast("array<double>")).drop(z)


def _centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """S / n as the nearest integers and what is left, exact to the last bit of the rest."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, dtype=np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)])


def _length(rows: DataFrame) -> int:
    top = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0]["d"] if top else 0


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, dims: int | None = None) -> Whitening | None:
    """The whitening of a table; None if there is no vector with an entry."""
    spark = rows.sparkSession
    small_batches(spark)
    x = rows.where(usable(F.col(vector_col))).select(integers(F.col(vector_col)).alias("x"))
    dims = _length(x) if dims is None else dims
    if not dims:
        return None
    each = materialize(x.where(F.size("x") == dims).distinct(), "vectors")
    got = {r["dim"]: int(r["s"]) for r in each.mapInArrow(_sums, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()}
    if not got:
        drop(each)
        return None
    n, sums = got[-1], [got[k] for k in range(dims)]
    send = spark.sparkContext.broadcast
    centre = send(_centre(sums, n))
    v = _covariance(each, n, centre)
    values, vectors = leading(v, components)
    error = 0.0
    if len(values):
        white = _covariance(each, n, centre, send(vectors / np.sqrt(values)))
        error = float(np.abs(white - np.eye(len(values))).max())
    drop(each)
    return Whitening(n, dims, sums, float(np.trace(v)), values, vectors, error)


def _deviations(z: np.ndarray, rest: list[int], n: int) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, exact: z is x less the whole centre, rest is S less n times that."""
    size = (n * int(np.abs(z).max(initial=0)) + max(map(abs, rest), default=0)) ** 2 * max(1, len(rest))
    if size < 1 << 63:
        return ((n * z - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in z]
    return [e if e < 1 << 63 else None for e in exact]


def _projector(model, explained: list[float], error: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scaled = model.value
        whole, rest = _centre(sums, n)
        left, m = [s - n * int(w) for s, w in zip(sums, whole, strict=True)], scaled.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch.column(1)) - whole
            white = (z.astype(float) - rest) @ scaled
            many = np.repeat(np.arange(batch.num_rows), m)
            k = np.tile(np.arange(1, m + 1, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(many)), pa.array(k), pa.array(np.full(len(k), n, np.int64)), pa.array(_deviations(z, left, n), pa.int64()).take(pa.array(many)),
                    pa.array(white.ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(k), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return project


def components_of(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, dims: int | None = None) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    model = fit(rows, vector_col, components, dims)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    told = spark.sparkContext.broadcast((model.n, model.sums, model.vectors / np.sqrt(model.values)))
    x = rows.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), integers(F.col(vector_col)).alias("x")).where(F.size("x") == model.dims)
    return x.mapInArrow(_projector(told, model.explained.tolist(), model.identity_error), schema)
