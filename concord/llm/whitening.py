"""Whitening of embeddings by incremental eigendecomposition.

Vectors become whole numbers, so that sums over all of them are exact in any order. After one pass for the mean, each task
holds an eigendecomposition and takes centred vectors in by rank-one updates: the eigenvalues of diag(d) + z z^T are the roots
of a secular equation, solved between their poles by bisection and Newton steps; directions in which z vanishes and equal
eigenvalues are deflated, that is they keep their eigenvectors. A block of vectors is first reduced by orthogonal rotations to
as many vectors as it has dimensions, with the same sum of outer products, and these are the updates. The spectra of the
tasks are combined in groups, one spectrum taking in the eigenvectors of the others, scaled, by rank-one updates as
well, until one is left.

That basis carries the rounding of many updates. A last pass over all vectors forms the covariance inside it (Rayleigh-Ritz) and
turns the basis by the small matrix's eigenvectors; whitened values come from the turned basis.

What leaves a task is a few numbers for each dimension, or for each pair of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.session import cut_lineage

SCALE, SHIFT = 64.0, 1_000_000
#: Whole numbers up to which doubles have no gaps.
WIDEST = 1 << 53
#: Vectors reduced at once, spectra combined by one task, vectors turned into rows at once.
BLOCK, FAN_IN, OUT_ROWS = 1024, 8, 512
#: An eigenvalue of less than this part of the largest one is rounding: its direction cannot be whitened.
NOTHING = 1e-12
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z_i^2 / (d_i - x)) = 0 for strictly rising d and z without zeros, one right of each d_i. A root is
    given as the nearer pole and its distance from it, so that differences to poles stay exact."""
    n, w = len(d), z * z
    gaps = np.append(np.diff(d), w.sum())
    # the sign at the middle of a gap tells which pole is nearer
    middle = 1 + (w / (d[None, :] - d[:, None] - gaps[:, None] / 2)).sum(1)
    left = middle >= 0
    left[-1] = True
    pole = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    shifted = d[None, :] - d[pole][:, None]
    low = np.where(left, 0.0, -gaps / 2)
    high = np.where(left, gaps / 2, 0.0)
    high[-1] = gaps[-1] * (1 + 4 * EPS)
    # near its pole a root behaves like w / rest: begin there
    x = (low + high) / 2
    for _ in range(120):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            terms = w / (shifted - x[:, None])
            value = 1 + terms.sum(1)
            slope = (terms / (shifted - x[:, None])).sum(1)
            # the equation grows between two poles
            low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
            # Newton for the equation times the distance from the near pole, which is almost straight there
            g, dg = value * x, value + x * slope
            step = x - g / dg
        done = (np.abs(value) <= 4 * EPS * (1 + np.abs(terms).sum(1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        inside = np.isfinite(step) & (step > low) & (step < high)
        bent = np.where(low * high > 0, np.sign(low + high) * np.sqrt(np.abs(low * high)), (low + high) / 2)
        x = np.where(done, x, np.where(inside, step, bent))
    return pole, x


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of vectors diag(values) vectors^T + z z^T."""
    z = vectors.T @ z
    norm = np.sqrt(z @ z)
    if norm == 0:
        return values, vectors
    order = np.argsort(values, kind="stable")
    values, vectors, z = values[order], vectors[:, order], z[order]
    tolerance = 8 * EPS * max(abs(values[-1]), norm * norm)
    vectors = vectors.copy()
    # of equal eigenvalues one takes the whole of z, by rotations of their eigenvectors
    last = -1
    for i in range(len(z)):
        if abs(z[i]) * norm <= tolerance:
            z[i] = 0.0
            continue
        if last >= 0 and values[i] - values[last] <= tolerance:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            a, b = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
            z[last], z[i] = 0.0, r
        last = i
    live = np.flatnonzero(z)
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    pole, x = secular_roots(d, w)
    # apart[i, j] = d_i - root_j, from the pole's distance
    apart = (d[:, None] - d[pole][None, :]) - x[None, :]
    apart[apart == 0] = EPS * max(abs(d[-1]), 1e-300)
    # z for which the roots found are exact: keeps the eigenvectors orthogonal
    ratio = -apart / np.where(np.eye(len(d), dtype=bool), 1.0, d[:, None] - d[None, :])
    shape = np.abs(ratio)
    exact = np.sqrt(np.exp(np.log(shape).sum(1))) * np.sign(w)
    inner = exact[:, None] / apart
    inner /= np.sqrt((inner * inner).sum(0))
    new_values, new_vectors = values.copy(), vectors
    new_values[live] = d[pole] + x
    new_vectors[:, live] = vectors[:, live] @ inner
    return new_values, new_vectors


class Spectrum:
    """Eigendecomposition of a sum of outer products, taken in one at a time."""

    def __init__(self, dims: int):
        self.values, self.vectors, self.taken = np.zeros(dims), np.eye(dims), 0

    def add(self, z: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, z)
        self.taken += 1
        if self.taken % 256 == 0:
            # keep the vectors orthogonal over long runs
            q, r = np.linalg.qr(self.vectors)
            self.vectors = q * np.sign(np.diag(r))

    def add_block(self, rows: np.ndarray) -> None:
        """The rows' outer products, as those of the at most `dims` rows of their triangular factor."""
        for row in np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows:
            self.add(row)

    def add_spectrum(self, values: np.ndarray, vectors: np.ndarray) -> None:
        for value, vector in zip(values, vectors.T, strict=True):
            if value > 0:
                self.add(np.sqrt(value) * vector)


def whole_numbers(batch: pa.RecordBatch, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that count and their whole numbers. A row counts if it has `dims` finite entries."""
    column = batch.column(1)
    column = column.cast(pa.large_list(column.type.value_type))
    sizes = np.where(np.asarray(column.is_null()), -1, np.asarray(column.value_lengths().fill_null(-1)))
    if dims is None:
        return sizes, None
    chosen = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(chosen)).flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(chosen), dims)
    good = np.isfinite(values).all(1)
    whole = np.floor(SCALE * values[good])
    if np.abs(whole).max(initial=0) >= WIDEST:
        raise OverflowError(f"an entry of a vector is beyond {WIDEST / SCALE:g}")
    return chosen[good], whole.astype(np.int64) + SHIFT


def usual_dims(vectors: DataFrame) -> int:
    """The most frequent length of a vector without null or non-finite entries, of equally frequent ones the greatest."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            lengths, _ = whole_numbers(batch, None)
            for size in np.unique(lengths[lengths > 0]).tolist():
                counts[size] = counts.get(size, 0) + len(whole_numbers(batch, size)[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (counts.keys(), counts.values())], ["size", "n"])

    found = vectors.mapInArrow(sizes, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).where("n > 0")
    first = found.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def summed(frame: DataFrame) -> np.ndarray:
    """Sums over all rows (place, value) by place; as many rows as there are places."""
    rows = frame.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toArrow()
    return np.array(rows["value"].to_pylist(), dtype=object)


def first_moments(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for batch in batches:
            _, x = whole_numbers(batch, dims)
            n += len(x)
            # in two halves, neither of which can pass a long
            high, low = (x >> 20).sum(0).tolist(), (x & ((1 << 20) - 1)).sum(0).tolist()
            total = [t + (a << 20) + b for t, a, b in zip(total, high, low, strict=True)]
        values = [n, *total]
        # decimals: the sums of all rows may pass a long
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["place", "value"])

    found = [int(v) for v in summed(vectors.mapInArrow(sums, "place int, value decimal(38,0)"))]
    return found[0], found[1:]


class Centre:
    """Exact centring: whole parts of the means are taken off as whole numbers, the rest as fractions."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.over = np.array([s % n for s in sums], np.int64)
        self.rest = self.over / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, exact."""
        y = x - self.whole
        widest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if widest * widest * x.shape[1] < 1 << 63:
            apart = self.n * y - self.over
            return (apart * apart).sum(1).tolist()
        apart = self.n * y.astype(object) - self.over.astype(object)
        return [int(v) for v in (apart * apart).sum(1)]


def basis(vectors: DataFrame, dims: int, centre: Centre) -> np.ndarray:
    """Eigenvectors of the sum of outer products of all centred vectors, by rank-one updates in tasks and between them."""

    def take_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting = Spectrum(dims), []
        for batch in batches:
            waiting.append(centre(whole_numbers(batch, dims)[1]))
            if sum(map(len, waiting)) >= BLOCK:
                rows = np.concatenate(waiting)
                for at in range(0, len(rows) // BLOCK * BLOCK, BLOCK):
                    own.add_block(rows[at : at + BLOCK])
                waiting = [rows[len(rows) // BLOCK * BLOCK :]]
        if waiting and sum(map(len, waiting)):
            own.add_block(np.concatenate(waiting))
        if own.taken:
            yield pa.RecordBatch.from_arrays([pa.array([own.values.tolist()]), pa.array([own.vectors.ravel().tolist()])], ["d", "u"])

    def combine(group: pa.Table) -> pa.Table:
        own = Spectrum(dims)
        spectra = [(np.array(d), np.array(u).reshape(dims, dims)) for d, u in zip(group["d"].to_pylist(), group["u"].to_pylist(), strict=True)]
        own.values, own.vectors = spectra[0]
        for values, turned in spectra[1:]:
            own.add_spectrum(values, turned)
        return pa.table({"d": pa.array([own.values.tolist()]), "u": pa.array([own.vectors.ravel().tolist()])})

    kind = "d array<double>, u array<double>"
    spectra = cut_lineage(vectors.mapInArrow(take_in, kind).withColumn("i", F.monotonically_increasing_id()), "spectra")
    left = spectra.count()
    while left > 1:
        # the ids of the tasks are spread evenly enough by a hash
        groups = -(-left // FAN_IN)
        dealt = spectra.select(F.pmod(F.xxhash64("i"), F.lit(groups)).alias("g"), "d", "u")
        spectra = dealt.groupBy("g").applyInArrow(combine, kind).withColumn("i", F.monotonically_increasing_id())
        spectra = cut_lineage(spectra, "spectra")
        left = spectra.count()
    return np.array(spectra.first().u).reshape(dims, dims)


def covariance(vectors: DataFrame, dims: int, centre: Centre, turn: np.ndarray) -> np.ndarray:
    """Covariance of the centred vectors times `turn`, centred once more so that rounding of the means cancels."""
    k = turn.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            _, x = whole_numbers(batch, dims)
            for at in range(0, len(x), BLOCK):
                y = centre(x[at : at + BLOCK]) @ turn
                total += y.T @ y
                sums += y.sum(0)
        values = np.concatenate([total.ravel(), sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["place", "value"])

    found = summed(vectors.mapInArrow(products, "place int, value double")).astype(float) / centre.n
    mean = found[k * k :]
    return found[: k * k].reshape(k, k) - np.outer(mean, mean)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Per row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors whose length is not the
    usual one (`usual_dims`). Each entry c counts as floor(64 c) + 1,000,000. Components are numbered from 1 by falling
    variance; there are at most `components`, and none for directions without variance, so one vector, or equal ones, or an
    empty table give no row. Repeated rows and ids and null ids are rows like any other. A deviation that passes a long
    raises an error. Other columns are not read.
    """
    vectors = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    dims = usual_dims(vectors)
    n, sums = first_moments(vectors, dims) if dims else (0, [])
    if n < 2:
        return spark.createDataFrame([], kind)
    centre = Centre(n, sums)
    start = basis(vectors, dims, centre)
    q, _ = np.linalg.qr(start)
    inside = covariance(vectors, dims, centre, q)
    values, turned = np.linalg.eigh((inside + inside.T) / 2)
    values, turned = values[::-1], (q @ turned)[:, ::-1]
    rank = int((values > NOTHING * values[0]).sum()) if values[0] > 0 else 0
    k = min(components, rank)
    if not k:
        return spark.createDataFrame([], kind)
    explained = (values / np.trace(inside))[:k]
    turn = turned[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(covariance(vectors, dims, centre, turn) - np.eye(k)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, x = whole_numbers(batch, dims)
            ids = batch.column(0).take(pa.array(chosen))
            for at in range(0, len(x), OUT_ROWS):
                part = x[at : at + OUT_ROWS]
                m = len(part)
                own = np.repeat(np.arange(at, at + m), k)
                columns = [
                    ids.take(pa.array(own)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(centre.deviation(part), pa.int64()).take(pa.array(own - at)),
                    pa.array((centre(part) @ turn).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in kind.split(", ")])

    return vectors.mapInArrow(rows, kind)
