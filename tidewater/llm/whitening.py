"""Whitening of embeddings on their leading principal components, found by FEAST contour integration.

Vectors are taken in whole steps: an entry c becomes floor(SCALE * c) + OFFSET, so that sums are exact. Spark jobs take the
sums, then the covariance of the centred vectors, then project all of them. What reaches the driver are sums of `dim`
numbers and one covariance of dim x dim numbers, whatever the number of vectors.

The eigenvalues wanted are first located by inertia counts (Sturm sequences of the tridiagonal form tell how many
eigenvalues lie below a shift) and parted into intervals whose ends lie in gaps. For each interval FEAST (Polizzi) applies
the spectral projector to a block of vectors: a Gauss-Legendre quadrature of (zI - V)^-1 Y along a half circle about the
interval, one complex shifted solve a node. Rayleigh-Ritz on the result gives Ritz pairs; it is repeated until those in the
interval have vanishing residuals and are as many as the inertia counts say, with a larger block where they are not.

Defined cases: vectors that are null or hold null or non-finite entries (or entries beyond 2^48, whose steps leave the
range in which sums are exact) give no rows, and neither does an empty vector. Vectors of each length are fitted on their
own. Components whose eigenvalue is below ZERO times the largest have no variance in double precision: they aren't
returned, so that vectors that are all equal give no rows. `deviation` is null where it doesn't fit in a long. Rows that
repeat an id, or have none, give rows each. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.tables import spread
from tidewater.sources.work import materialize

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
TASKS_PER_CORE = 4
#: An eigenvalue below this share of the largest counts as 0.
ZERO = 1e-11
#: Quadrature nodes on the half circle; eigenvalues of an interval; room in a block beside them.
NODES, GROUP, ROOM = 8, 8, 1.5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of an orthogonally similar tridiagonal matrix, by Householder reflections."""
    a = matrix.copy()
    n = len(a)
    off = np.zeros(max(n - 1, 0))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        off[k] = -size if x[0] > 0 else size
        if not size:
            continue
        x[0] -= off[k]
        x /= np.linalg.norm(x)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ x
        p -= (x @ p) * x
        inner -= 2.0 * (np.outer(x, p) + np.outer(p, x))
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off


def count_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    shifts = np.asarray(shifts, np.float64)
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(off * off, initial=0.0)))
    found, pivot = np.zeros(len(shifts), np.int64), np.ones(len(shifts))
    for i, d in enumerate(diagonal):
        pivot = d - shifts - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        found += pivot < 0
    return found


def locate(diagonal: np.ndarray, off: np.ndarray, steps: int = 60) -> np.ndarray:
    """All eigenvalues by falling value, by bisection on the counts."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(n, float((diagonal - reach).min())), np.full(n, float((diagonal + reach).max()))
    wanted = n - 1 - np.arange(n)  # so many lie below the i-th largest
    for _ in range(steps):
        middle = (low + high) / 2
        up = count_below(diagonal, off, middle) <= wanted
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return (low + high) / 2


def _cuts(values: np.ndarray, k: int) -> list[int]:
    """Ends of groups of eigenvalues (by falling value), each in a wide gap; the last is at k or beyond it."""
    gaps = np.append(values[:-1] - values[1:], np.inf)  # the gap below each
    least, ends = 1e-9 * values[0], []
    while not ends or ends[-1] < k:
        first = ends[-1] if ends else 0
        range_ = [i for i in range(first + GROUP // 2, min(first + 2 * GROUP, len(values)) + 1) if i >= min(k, first + GROUP // 2)] or [len(values)]
        end = max(range_, key=lambda i: gaps[i - 1] if i < len(values) else least)
        while end < len(values) and gaps[end - 1] < least:
            end += 1
        ends.append(end)
    return ends


def _projected(matrix: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The block projected on the eigenvectors of the interval, by quadrature of shifted solves."""
    points, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius, eye = (low + high) / 2, (high - low) / 2, np.eye(len(matrix))
    out = np.zeros_like(block)
    for x, w in zip(points, weights, strict=True):
        ray = radius * np.exp(0.5j * np.pi * (1 + x))
        out += 0.5 * w * (ray * np.linalg.solve((centre + ray) * eye - matrix, block.astype(complex))).real
    return out


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors of the block's span."""
    basis, _ = np.linalg.qr(block)
    values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
    return values, basis @ turned


def eigenpairs_between(matrix: np.ndarray, low: float, high: float, wanted: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` eigenpairs with low < value < high, as many as inertia counts say there are."""
    n, size, nodes = len(matrix), int(ROOM * wanted) + 2, NODES
    limit = 40 * np.finfo(float).eps * np.linalg.norm(matrix)
    while True:
        size = min(size, n)
        block = np.random.default_rng(seed).standard_normal((n, size))
        for _ in range(12):
            if size < n:
                block = _projected(matrix, block, low, high, nodes)
            values, block = _ritz(matrix, block)
            inside = np.flatnonzero((values > low) & (values < high))
            left = np.linalg.norm(matrix @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if len(inside) == wanted and (left <= limit).all():
                return values[inside], block[:, inside]
            if size == n:  # the block is the whole space: nothing can be missed
                order = np.argsort(np.abs(values - (low + high) / 2), kind="stable")[:wanted]
                return values[order], block[:, order]
        size, nodes = 2 * size, 2 * nodes


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k eigenvalues by falling value, without those that are 0, and their unit eigenvectors as columns."""
    matrix = (matrix + matrix.T) / 2
    scale = float(np.abs(matrix).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off = tridiagonal(matrix / scale)
    near = locate(diagonal, off)
    k = min(k, int((near > ZERO * near[0]).sum()))
    vectors, first, above = [], 0, near[0] + 0.05 * abs(near[0])
    for end in _cuts(near, k):
        below = (near[end - 1] + near[end]) / 2 if end < len(near) else near[-1] - 0.05 * abs(near[0])
        between = count_below(diagonal, off, np.array([below, above]))
        vectors.append(eigenpairs_between(matrix / scale, below, above, int(between[1] - between[0]))[1])
        first, above = end, below
    values, whole = _ritz(matrix / scale, np.concatenate(vectors, axis=1))
    order = np.argsort(-values, kind="stable")[:k]
    whole = whole[:, order]
    whole = whole / np.linalg.norm(whole, axis=0)
    sign = np.sign(whole[np.abs(whole).argmax(axis=0), np.arange(len(order))])
    return values[order] * scale, whole * sign


@dataclass
class Fit:
    """What is known of the vectors of one length: their number, mean (whole steps and the rest), and components."""

    n: int
    whole: np.ndarray
    rest: np.ndarray  # n * mean - n * whole, from 0 to n - 1
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum of (n * x - S)^2 of each vector."""
        near = x - self.whole
        size = ((self.n * near.astype(np.float64) - self.rest) ** 2).sum(axis=1)
        fits = size < 9.0e18
        with np.errstate(over="ignore"):
            exact = ((self.n * near - self.rest) ** 2).sum(axis=1)
        if fits.all():
            return pa.array(exact)
        out = exact.tolist()
        for i in np.flatnonzero(~fits).tolist():
            value = sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(near[i], self.rest, strict=True)) if size[i] < 9.5e18 else 1 << 63
            out[i] = value if value < 1 << 63 else None
        return pa.array(out, pa.int64())


def whole_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in whole steps) for each length in a batch; rows without a usable vector are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) <= 2.0**48))])
    good = (bad[start + lengths] == bad[start]) & (lengths > 0)
    for length in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == length))
        entries = flat[start[rows][:, None] + np.arange(length)]
        yield rows, np.floor(SCALE * entries).astype(np.int64) + OFFSET


def _sums(vectors: DataFrame, add: Callable[[np.ndarray], np.ndarray], kind: str, which: list[int] | None = None) -> DataFrame:
    """(length, i, values): sums over all vectors of the matrices that `add` gives for a block of them, row by row.

    Each task adds up its blocks; the tasks' rows are then added by (length, i).
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_vectors(batch.column(batch.num_columns - 1)):
                length = x.shape[1]
                if which is None or length in which:
                    more = add(x)
                    total[length] = total[length] + more if length in total else more
        task = TaskContext.get().partitionId()
        for length, rows in total.items():
            n, wide = rows.shape
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * wide), pa.array(rows.ravel()))
            columns = [pa.array(np.full(n, length)), pa.array(np.arange(n)), pa.array(np.full(n, task, np.int64)), values]
            yield pa.RecordBatch.from_arrays(columns, ["length", "i", "task", "values"])

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")  # the same order of additions in each run
        found = rows.column("values").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
        return pa.table({"length": rows.column("length")[:1], "i": rows.column("i")[:1], "values": pa.array([found], pa.list_(pa.from_numpy_dtype(found.dtype)))})

    tasks = TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    parts = spread(vectors).coalesce(tasks).mapInArrow(partial, f"length long, i long, task long, values array<{kind}>")
    return parts.groupBy("length", "i").applyInArrow(whole, f"length long, i long, values array<{kind}>")


def _matrix(rows: DataFrame, length: int) -> np.ndarray:
    found = rows.filter(F.col("length") == length).collect()  # at most a row for each dimension
    return np.array([r["values"] for r in sorted(found, key=lambda r: r["i"])])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fits of each length of the array column `vector`."""

    def sums(x: np.ndarray) -> np.ndarray:  # in two halves of 32 bits, so that no sum leaves the range
        return np.stack([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), np.full(x.shape[1], len(x))])

    vectors = vectors.select("vector")
    stored, fits = materialize(_sums(vectors, sums, "long"), "vector_sums"), {}
    for (length,) in stored.select("length").distinct().collect():  # the lengths there are
        high, low, count = _matrix(stored, length).astype(object)
        total, n = high * (1 << 32) + low, int(count[0])
        fits[length] = Fit(n, (total // n).astype(np.int64), (total % n).astype(np.int64))
    if not fits:
        return {}
    products = materialize(_sums(vectors, lambda x: (c := fits[x.shape[1]].centred(x)).T @ c, "double"), "vector_products")
    for length, known in fits.items():
        covariance = _matrix(products, length) / known.n
        known.values, known.vectors = leading_eigenpairs(covariance, components)
        trace = float(np.trace(covariance))
        known.explained = known.values / trace if trace else known.values
    some = [length for length, known in fits.items() if len(known.values)]
    if some:

        def moments(x: np.ndarray) -> np.ndarray:
            z = fits[x.shape[1]].whitened(x)
            return np.concatenate([z.T @ z, z.sum(axis=0)[None]])

        squares = materialize(_sums(vectors, moments, "double", some), "vector_moments")
        for length in some:
            known, found = fits[length], _matrix(squares, length)
            mean = found[-1] / known.n  # of centred vectors: 0 but for rounding
            known.identity_error = float(np.abs(found[:-1] / known.n - np.outer(mean, mean) - np.eye(len(known.values))).max())
    return fits


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1, by falling variance), n, deviation (the sum of
    (n * x - S)^2), whitened, explained (share of the whole variance) and identity_error (how far the covariance of the
    whitened vectors is from the identity, at most).
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    fits = fit(rows, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_vectors(batch.column(1)):
                known = fits.get(x.shape[1])
                k = len(known.values) if known else 0
                if not k:
                    continue
                each = pa.array(np.repeat(np.arange(len(at)), k))
                columns = [
                    batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), known.n, np.int64)),
                    known.deviation(x).take(each), pa.array(known.whitened(x).ravel()), pa.array(np.tile(known.explained, len(at))), pa.array(np.full(len(each), known.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = vectors.schema[vec_id].dataType.simpleString()
    return spread(rows).mapInArrow(project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
