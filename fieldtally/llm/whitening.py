"""Whitening of vectors by their leading principal components, found by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .vector_tables import matrix, usable

# Quadrature nodes on the upper half of a contour, and eigenvalues that one interval should hold.
NODES, HELD = 8, 6
# Eigenvalues below this share of the largest count as zero.
ZERO = 1e-12
# Distance, as a share of the norm, that the ends of an interval keep from every eigenvalue.
CLEAR = 1e-9
ROUNDS = 40


def _above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above `shift`: its inertia, by a pivoted L D L' of 1 x 1 and 2 x 2 blocks."""
    m = a - shift * np.eye(len(a))
    positive = 0
    while len(m):
        size = np.abs(m)
        one = int(size.diagonal().argmax())
        r, s = np.unravel_index(int(size.argmax()), m.shape)
        if size[r, s] == 0:
            break
        pivots = [one] if size[one, one] >= 0.64 * size[r, s] else [r, s]
        rest = np.delete(np.arange(len(m)), pivots)
        block, side = m[np.ix_(pivots, pivots)], m[np.ix_(rest, pivots)]
        positive += int(block[0, 0] > 0) if len(pivots) == 1 else 1  # a 2 x 2 block has one of each sign
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        m = (m + m.T) / 2
    return positive


def _clear_cut(a: np.ndarray, at: float, step: float) -> tuple[float, int]:
    """A place at or shortly after `at` with no eigenvalue close by, and how many lie above."""
    for k in range(2 * len(a) + 2):
        place = at + k * step
        low, high = _above(a, place - CLEAR), _above(a, place + CLEAR)
        if low == high:
            return place, low
    raise ArithmeticError("no gap between eigenvalues")


def _intervals(a: np.ndarray, want: int) -> list[tuple[float, float, int]]:
    """Intervals from the top down that hold the `want` largest eigenvalues, with the number in each by inertia."""
    top, none = _clear_cut(a, 1.0 + 8 * CLEAR, 4 * CLEAR)
    bottom, known = _clear_cut(a, ZERO, -4 * CLEAR) if _above(a, ZERO) < len(a) else (-4 * CLEAR, len(a))
    out, open_ones = [], [(bottom, top, known, none)]
    while open_ones:
        low, high, below, above = open_ones.pop()
        if above >= want or below == above:
            continue
        if below - above <= HELD or high - low < 1e3 * CLEAR:
            out.append((low, high, below - above))
            continue
        middle, count = _clear_cut(a, (low + high) / 2, 4 * CLEAR)
        open_ones += [(low, middle, below, count), (middle, high, count, above)]
    return out


def _filtered(a: np.ndarray, low: float, high: float, start: np.ndarray) -> np.ndarray:
    """`start` projected on the eigenvectors of an interval: shifted solves along a circle around it."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi * (1 + nodes) / 2)
    radius, centre = (high - low) / 2, (high + low) / 2
    shifted = (centre + radius * turn)[:, None, None] * np.eye(len(a)) - a
    solved = np.linalg.solve(shifted, np.broadcast_to(start.astype(complex), (NODES, *start.shape)))
    return ((weights / 2 * radius * turn)[:, None, None] * solved).real.sum(axis=0)


def _ritz(a: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz values, vectors and residuals in the span of `basis`."""
    q = np.linalg.qr(basis)[0]
    values, turned = np.linalg.eigh(q.T @ a @ q)
    vectors = q @ turned
    return values, vectors, np.linalg.norm(a @ vectors - vectors * values, axis=0)


def _of_interval(a: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """The eigenvectors of an interval, as many as its inertia says."""
    exact = 16 * np.finfo(float).eps
    random = np.random.Generator(np.random.PCG64(len(a)))
    size = min(len(a), 2 * count + 4)
    while True:
        basis, last = random.standard_normal((len(a), size)), np.inf
        for _ in range(ROUNDS):
            values, vectors, residual = _ritz(a, _filtered(a, low, high, basis))
            inside = (values > low) & (values <= high)
            worst = residual[inside].max(initial=0)
            if inside.sum() == count and (worst <= exact or (worst < 1e-12 and worst > last / 2)):
                return vectors[:, inside]
            basis, last = vectors, worst
        if size == len(a):
            raise ArithmeticError(f"{count} eigenvalues counted between {low} and {high}, {inside.sum()} found")
        size = min(len(a), 2 * size)


def leading_components(covariance: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The `want` largest eigenvalues that are not zero, falling, and their unit eigenvectors in columns.

    Inertia counts cut the spectrum into intervals; each is projected on by contour integration and
    refined until all eigenvectors counted there are found. Signs make each vector's largest entry positive.
    """
    norm = float(np.abs(covariance).sum(axis=1).max(initial=0))
    if norm == 0:
        return np.zeros(0), np.zeros((len(covariance), 0))
    a = covariance / norm
    found = [_of_interval(a, *interval) for interval in _intervals(a, want)]
    values, vectors, _ = _ritz(a, np.column_stack(found))
    order = np.argsort(-values, kind="stable")[:want]
    order = order[values[order] > ZERO * values.max()]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values * norm, vectors * signs


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums in whole numbers, of Python's kind where a long might not hold their squares' sum."""
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0) * n * 2
    if most * most * max(1, x.shape[1]) < 2.0 ** 62 and max(map(abs, sums), default=0) < 2 ** 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _exact(x, n, sums).astype(np.float64) / n


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths):
        own = batch.take(pa.array(np.flatnonzero(lengths == dims)))
        yield int(dims), own, matrix(own.column("x"), int(dims), np.int64)


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number of vectors and exact sums of their entries, by length."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, x in _by_length(batch):
                safe = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0 ** 62
                total = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
                held[dims] = held.get(dims, 0) + np.append(total, len(x))
        rows = [(dims, place, int(v)) for dims, total in held.items() for place, v in enumerate(total)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [
            pa.array([], k) for k in kinds], names=["dims", "place", "total"])

    parts = fit.mapInArrow(add, "dims int, place int, total decimal(38,0)")
    totals: dict[int, dict[int, int]] = {}
    for dims, place, total in parts.groupBy("dims", "place").agg(F.sum("total")).collect():
        totals.setdefault(dims, {})[place] = int(total)
    return {dims: (t[dims], np.array([t[i] for i in range(dims)], dtype=object)) for dims, t in totals.items()}


def _moments(fit: DataFrame, fits: dict, of: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
    """Mean products of what `of` makes of centred vectors, by length: each task adds up a matrix, Spark adds the tasks'."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, x in _by_length(batch):
                z = of(_centred(x, *fits[dims]), dims)
                held[dims] = held.get(dims, 0) + z.T @ z
        for dims, total in held.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                 pa.array(total[i, j])], names=["dims", "i", "j", "total"])

    parts = fit.mapInArrow(add, "dims int, i int, j int, total double")
    out: dict[int, np.ndarray] = {}
    for dims, i, j, total in parts.groupBy("dims", "i", "j").agg(F.sum("total")).collect():
        size = of(np.zeros((0, dims)), dims).shape[1]
        out.setdefault(dims, np.zeros((size, size)))[[i, j], [j, i]] = total / fits[dims][0]
    return out


def whitened(vectors: DataFrame, components: int = 16, scale: int = 64) -> DataFrame:
    """Whitened coordinates: vec_id, component, n, deviation, whitened, explained, identity_error.

    `vectors(vec_id, embedding)`. Entries become x = floor(scale * c); a constant added to all of them would change nothing
    below, since all is centred. The n distinct x with their sums S are what is fitted: their covariance V (divisor n, centred
    first) and its eigenvectors for the `components` largest eigenvalues e, numbered from 1. One row for
    each vector and component: deviation is the exact sum of (n * x - S)^2 (null where a long can't hold it), whitened is the
    projection of x - S / n over sqrt(e), explained is e over the trace of V, identity_error the largest absolute entry of the
    covariance of whitened, over the fitted vectors, minus the identity.

    Vectors that are null or empty or hold null or non-finite entries are left out; a null vec_id is kept; repeated rows are
    fitted once and each returned. Vectors of another length are another fit. Components whose eigenvalue is zero (up to rounding) do not exist, so
    that equal vectors alone give no rows, nor does an empty table. Entries beyond the range of a long are its ends. Further
    columns are left out. The driver holds a few matrices of the vectors' length squared, whatever the number of rows.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.filter(usable("embedding")).select("vec_id", x.alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    fits = _sums(fit)
    covariance = _moments(fit, fits, lambda z, dims: z)
    found = {dims: (*leading_components(v, min(components, dims)), float(np.trace(v))) for dims, v in covariance.items()}
    turn = {dims: vectors / np.sqrt(values) for dims, (values, vectors, _) in found.items()}
    check = _moments(fit, fits, lambda z, dims: z @ turn[dims])
    error = {dims: float(np.abs(c - np.eye(len(c))).max(initial=0)) for dims, c in check.items()}
    discard(fit)  # what follows needs the fitted numbers only
    largest = np.iinfo(np.int64).max
    kind = vectors.schema["vec_id"].dataType

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, own, x in _by_length(batch):
                n, sums = fits[dims]
                values, _, trace = found[dims]
                held = len(values)
                if not held:
                    continue
                exact = _exact(x, n, sums)
                squares = (exact * exact).sum(axis=1)
                deviation = pa.array([int(v) if v <= largest else None for v in squares], pa.int64())
                take = pa.array(np.repeat(np.arange(len(x)), held))
                size = len(take)
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id").take(take), pa.array(np.tile(np.arange(1, held + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(size, n)), deviation.take(take), pa.array((_centred(x, n, sums) @ turn[dims]).ravel()),
                     pa.array(np.tile(values / trace, len(x))), pa.array(np.full(size, error[dims]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, "
                                    "explained double, identity_error double")
