"""Embedding whitening by spectral divide and conquer (operator 13).

Entries become whole numbers, so counts, sums and products of the whole table
add up exactly, in any order and on any partitioning. Their covariance, a
matrix as wide as a vector and the only thing that reaches the driver, is split
by spectral projectors: the polar factor of the covariance minus a shift has
the eigenvalues 1 and -1, half of it plus the identity projects onto the
eigenvectors above the shift, and bases of both parts give two smaller
problems. The polar factor comes from QDWH iterations (by QR while the iterate
is badly conditioned, by Cholesky then). Parts are split down to single
components, which are then polished by one step on their residuals. The
components, scaled to unit variance, are broadcast and every row is projected.

Defined results: a row takes part if its vector is not null and holds only
finite entries; entries beyond 2**62 / 64 don't fit a long after scaling and
keep the row out too, and so does a length other than the most frequent one
(the larger of equally frequent ones; an empty vector never takes part). Zero
vectors, rows with a null or a shared id and equal rows do. Components without
variance (``FLAT`` of the largest or less) are given with a null ``whitened``
and don't enter ``identity_error``. ``deviation`` is null where it doesn't fit a
long. Of equal eigenvalues any basis may be returned. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE, OFFSET = 64, 1_000_000
#: Components returned.
COMPONENTS = 32
#: Share of the largest variance up to which a component counts as one without variance.
FLAT = 1e-13
#: Rows that a task works on at a time.
ROWS = 4096
_LONG = 2.0**62


def whole(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(width, rows, x)`` per length of vector: the rows that take part and their entries as longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = np.asarray(column.offsets, np.int64)
    holes = column.values.is_null().to_numpy(zero_copy_only=False)
    values = column.values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
    bad = np.concatenate([[0], np.cumsum(holes | ~(np.abs(scaled) < _LONG))])
    start, size = offsets[:-1], np.diff(offsets)
    good = valid & (size > 0) & (bad[offsets[1:]] == bad[start])
    for width in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == width))
        yield width, rows, scaled[start[rows][:, None] + np.arange(width)].astype(np.int64) + OFFSET


def _sums(batches):
    held: dict[int, list] = {}
    for batch in batches:
        for width, rows, x in whole(batch.column("v")):
            small = len(x) * float(np.abs(x).max()) < _LONG
            total = x.sum(axis=0) if small else x.astype(object).sum(axis=0)
            one = held.setdefault(width, [0, [0] * width])
            one[0] += len(rows)
            one[1] = [a + int(b) for a, b in zip(one[1], total, strict=True)]
    out = [(w, n, i, str(s)) for w, (n, sums) in held.items() for i, s in enumerate(sums)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
        names=["width", "n", "i", "s"],
    )


def sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """Length of the vectors that take part, their number, and the sum of each entry."""
    rows = (
        vectors.mapInArrow(_sums, "width long, n long, i long, s string")
        .groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    )
    best = rows.where("i = 0").orderBy(F.desc("n"), F.desc("width")).select("width", "n").first()
    if best is None:
        return 0, 0, []
    found = rows.where(F.col("width") == best["width"]).orderBy("i").collect()  # one row per entry of a vector
    return best["width"], best["n"], [int(r["s"]) for r in found]


def _products(width: int, centre: list[int]):
    middle = np.array(centre, np.int64)

    def task(batches):
        total = [[0] * width for _ in range(width)]
        for batch in batches:
            for w, _, x in whole(batch.column("v")):
                if w != width:
                    continue
                for at in range(0, len(x), ROWS):
                    y = x[at : at + ROWS] - middle
                    largest = float(np.abs(y).max())
                    if largest**2 * len(y) < 2.0**53:  # every sum is a whole number that doubles hold
                        part = (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
                    else:
                        part = y.T.astype(object) @ y.astype(object)
                    total = [[a + int(b) for a, b in zip(r, p, strict=True)] for r, p in zip(total, part, strict=True)]
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array([str(total[a][b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])], names=["i", "j", "s"]
        )

    return task


def covariance(vectors: DataFrame, width: int, n: int, total: list[int]) -> np.ndarray:
    """Exact covariance (divisor n), rounded once per entry.

    Entries are centred at the whole number below their mean before they are
    multiplied; what is left of the mean is taken off in whole numbers.
    """
    centre = [s // n for s in total]
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]
    rows = (
        vectors.mapInArrow(_products(width, centre), "i long, j long, s string")
        .groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # width * (width + 1) / 2 rows
    )
    out = np.zeros((width, width))
    for i, j, s in rows:
        out[i, j] = out[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    return out


def polar(a: np.ndarray) -> np.ndarray:
    """Polar factor of a symmetric matrix by QDWH iterations."""
    n = len(a)
    x = a / max(np.abs(a).sum(axis=0).max(), np.finfo(float).tiny)
    low, eye = np.finfo(float).eps, np.eye(n)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        p = math.sqrt(1 + d) + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * math.sqrt(1 + d)), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            both, _ = np.linalg.qr(np.concatenate([math.sqrt(r) * x, eye]))
            new = (q / r) * x + (p - q / r) / math.sqrt(r) * (both[:n] @ both[n:].T)
        else:
            z = np.linalg.inv(np.linalg.cholesky(eye + r * (x.T @ x)))
            new = (q / r) * x + (p - q / r) * (x @ z.T) @ z
        new = (new + new.T) / 2
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved < 1e-14 * math.sqrt(n) and 1 - low < 1e-15:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the subspaces above and below some shift; None where none was found that splits."""
    n, size = len(a), np.linalg.norm(a)
    diagonal, best = np.sort(np.diag(a)), None
    mean = diagonal.mean()
    seed = np.random.default_rng(n).standard_normal((n, n))
    for shift in (np.median(diagonal), mean, (diagonal[0] + mean) / 2, (diagonal[-1] + mean) / 2, (diagonal[0] + diagonal[-1]) / 2):
        u = polar(a - shift * np.eye(n))
        upper = (u + np.eye(n)) / 2
        k = int(round(np.trace(upper)))
        if not 0 < k < n:
            continue
        one, two = seed[:, :k], seed[:, k:]
        for _ in range(2):  # the second pass makes up for a badly conditioned start
            one, two = np.linalg.qr(upper @ one)[0], np.linalg.qr(two - upper @ two)[0]
        q, _ = np.linalg.qr(np.concatenate([one, two], axis=1))
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = (off, q[:, :k], q[:, k:])
        if off <= 1e-14 * n * size:
            break
    return best and best[1:]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""

    def parts(a: np.ndarray, basis: np.ndarray) -> list[np.ndarray]:
        if len(a) == 1:
            return [basis]
        away = a - np.diag(np.diag(a))
        spread = np.ptp(np.diag(a))
        if np.linalg.norm(away) + spread <= 1e-15 * len(a) * scale:
            return [basis]  # equal eigenvalues: any basis serves
        found = _split(a)
        if found is None:
            return [basis]
        return [p for q in found for p in parts(_symmetric(q.T @ a @ q), basis @ q)]

    n = len(v)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    scale = np.linalg.norm(v)
    if not scale:
        return np.zeros(n), np.eye(n)
    x = np.concatenate(parts(v, np.eye(n)), axis=1)
    for _ in range(2):  # polish: remove what is left of orthogonality and of other components
        missing, seen = np.eye(n) - x.T @ x, _symmetric(x.T @ v @ x)
        values = np.diag(seen) / (1 - np.diag(missing))
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > 1e-9 * scale
        np.fill_diagonal(apart, False)
        step = np.where(apart, (seen + values[None, :] * missing) / np.where(apart, gap, 1), missing / 2)
        x = x + x @ step
    values = np.einsum("ij,ij->j", x, v @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.linalg.norm(x[:, order], axis=0)


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """``n * x - S``, as longs where they fit, else as Python's whole numbers."""
    if float(np.abs(x).max(initial=0)) * n < _LONG and max(map(abs, total), default=0) < _LONG:
        return x * n - np.array(total, np.int64)
    return x.astype(object) * n - np.array(total, object)


def _whitened(x: np.ndarray, n: int, total: list[int], axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - S`` and the projections on ``axes`` of what each row has over the mean."""
    from_mean = deviations(x, n, total)
    return from_mean, (from_mean / n).astype(np.float64) @ axes


def _moments(width: int, n: int, total: list[int], axes: np.ndarray):
    def task(batches):
        k = axes.shape[1]
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for w, _, x in whole(batch.column("v")):
                if w == width:
                    _, y = _whitened(x, n, total, axes)
                    first += y.sum(axis=0)
                    second += y.T @ y
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(k, -1), i])), pa.array(np.concatenate([np.arange(k), j])), pa.array(np.concatenate([first, second[i, j]]))],
            names=["i", "j", "s"],
        )

    return task


def identity_error(vectors: DataFrame, width: int, n: int, total: list[int], axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    rows = vectors.mapInArrow(_moments(width, n, total, axes), "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    mean = {r["j"]: r["s"] / n for r in rows if r["i"] < 0}
    return max((abs(r["s"] / n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in rows if r["i"] >= 0), default=0.0)


def _projected(width: int, n: int, total: list[int], axes: np.ndarray, shares: np.ndarray, shown: int, error: float):
    def task(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for w, rows, x in whole(batch.column("v")):
                for at in range(0, len(rows) if w == width else 0, ROWS):
                    from_mean, y = _whitened(x[at : at + ROWS], n, total, axes)
                    m = len(y)
                    fits = (from_mean.astype(np.float64) ** 2).sum(axis=1) < 9.2e18
                    safe = np.where(fits[:, None], from_mean, 0).astype(np.int64)
                    full = np.full((m, shown), np.nan)
                    full[:, : y.shape[1]] = y
                    lacks = np.repeat((np.arange(shown) >= y.shape[1])[None, :], m, axis=0).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.repeat(rows[at : at + ROWS], shown))), pa.array(np.tile(np.arange(1, shown + 1), m), pa.int32()),
                         pa.array(np.full(m * shown, n)), pa.array(np.repeat((safe * safe).sum(axis=1), shown), mask=np.repeat(~fits, shown)),
                         pa.array(full.ravel(), mask=lacks), pa.array(np.tile(shares, m)), pa.array(np.full(m * shown, error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return task


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row per vector that takes part and component: the vector's whitened coordinate and what the fit says of both."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    only = rows.select("v")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width, n, total = sums(only)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    values, axes = components(covariance(only, width, n, total))
    shown = min(most, width)
    whole_variance = values.sum()
    real = int((values[:shown] > FLAT * values[0]).sum()) if values[0] > 0 else 0
    shares = np.maximum(values[:shown], 0) / whole_variance if whole_variance > 0 else np.zeros(shown)
    scaled = axes[:, :real] / np.sqrt(values[:real])
    error = identity_error(only, width, n, total, scaled)
    return rows.mapInArrow(_projected(width, n, total, scaled, shares, shown, error), schema)
