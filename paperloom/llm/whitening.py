"""Embedding whitening by incremental eigendecomposition.

Entries c of a vector become x = floor(256 c). The fit list holds each distinct x once; its
covariance V has the divisor n. Four steps:

1. Each partition of the fit list starts with an empty spectrum and takes one vector after
   the other: its deviation from the running mean is a rank-one update of the scatter matrix.
   Eigenvalues of the updated matrix are the roots of the secular equation
   1 + rho sum z_j^2 / (d_j - t) = 0, found for all intervals at once; eigenvectors follow from
   the weights for which the roots are exact. Entries of z that are nothing to the matrix, and
   all but one of those at equal eigenvalues, are deflated first.
2. Spectra of partitions are combined, a bounded number in a task, in rounds: the eigenpairs of
   one and the difference of the means are rank-one updates of the other.
3. Rayleigh-Ritz over all partitions: the covariance is summed anew in the basis found, and the
   small matrix that comes out, all but diagonal, is solved. So errors of the updates don't stay.
4. Rows are projected on the leading components and scaled.

The updates of a vector of d entries cost d^3 steps; the basis (d x d) is all that a task or the
driver holds besides its batch. Vectors of different widths have fit lists of their own.

Defined results: rows with a null vector, or with null or non-finite entries, are left out; a null
id stays null; repeated rows each get their rows; an empty table gives none; other columns are
ignored. A component without variance (one distinct vector, or fewer than components) has a null
`whitened`, and `explained` is 0, or null if no entry varies; such components don't count in
`identity_error`, which is null if there are no others. Vectors without entries have no components.
Entries are below 2^44 in size, and (n x - S)^2 summed must fit a long, else an OverflowError is raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import materialize

EPS = np.finfo(float).eps
#: Partial results that one task puts together.
FAN_IN = 16


def whole_entries(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector has finite entries only, with `x`, the entries times 256 as whole numbers."""
    finite = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col(vec_col).isNotNull() & finite).withColumn("x", F.transform(vec_col, lambda c: F.floor(c.cast("double") * 256)))


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z_j^2 / (d_j - t) for rising, distinct d and no zero in z: origins, offsets from these, and d_j - origin_i.

    Each root lies between neighbouring d and is told from the nearer one, so that differences to d stay exact.
    Steps fit a term with a pole at each end of the interval; those that leave the bracket halve it.
    """
    m = len(d)
    w = rho * z * z
    gap = np.append(np.diff(d), w.sum())
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (w / (d[None, :] - (d + gap / 2)[:, None])).sum(axis=1)
        right = middle < 0
        right[-1] = False
        origin = np.where(right, np.append(d[1:], 0), d)
        delta = d[None, :] - origin[:, None]
        below = np.tri(m, dtype=bool)
        lo, hi = np.where(right, -gap / 2, 0), np.where(right, 0, gap / 2)
        hi[-1] = gap[-1]
        lo[-1], t = (gap[-1] / 2 if middle[-1] < 0 else 0), None
        if middle[-1] >= 0:
            hi[-1] = gap[-1] / 2
        t = (lo + hi) / 2
        at = np.arange(m)
        for _ in range(60):
            far = delta - t[:, None]
            part = w / far
            slope = part / far
            psi, phi = np.where(below, part, 0).sum(axis=1), np.where(below, 0, part).sum(axis=1)
            g = 1 + psi + phi
            done = np.abs(g) <= 4 * EPS * m * (1 + np.abs(psi) + np.abs(phi))
            if done.all():
                break
            lo, hi = np.where(g < 0, t, lo), np.where(g > 0, t, hi)
            one, two = far[at, at], far[at, np.minimum(at + 1, m - 1)]
            d_psi, d_phi = np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
            c = g - one * d_psi - two * d_phi
            a, b = (one + two) * g - one * two * (d_psi + d_phi), one * two * g
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = one[-1] + one[-1] ** 2 * d_psi[-1] / (g[-1] - one[-1] * d_psi[-1])
            new = t + step
            bad = ~((new > lo) & (new < hi))
            new = np.where(bad, (lo + hi) / 2, new)
            t = np.where(done | (new == t), t, new)
            if ((hi - lo) <= 2 * EPS * np.abs(t)).all():
                break
    return origin, t, delta


class Spectrum:
    """Eigenvalues (rising) and eigenvectors of the scatter matrix of some vectors, their number and exact sums."""

    def __init__(self, width: int) -> None:
        self.n, self.sums = 0, np.zeros(width, np.int64)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        """One more vector: n / (n + 1) times the square of its deviation from the mean so far."""
        if self.n:
            self.update(x - self.sums / self.n, self.n / (self.n + 1))
        self.sums += x
        self.n += 1

    def merge(self, other: Spectrum) -> None:
        """All of another spectrum, an eigenpair at a time, then the difference of the means."""
        if not other.n:
            return
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector, value)
        if self.n:
            self.update(other.sums / other.n - self.sums / self.n, self.n * other.n / (self.n + other.n))
        self.sums += other.sums
        self.n += other.n

    def update(self, v: np.ndarray, rho: float) -> None:
        """Adds rho v v'."""
        d, u, z = self.values, self.vectors, self.vectors.T @ v
        size = float(z @ z)
        if not size or not rho:
            return
        small = 8 * EPS * max(d[-1], rho * size) if len(d) else 0.0
        if (np.diff(d) <= small).any():
            z, u = self.deflated(d, u, z, small)
        keep = rho * np.abs(z) * np.sqrt(size) > small
        if not keep.any():
            return
        d1, z1 = d[keep], z[keep]
        origin, t, delta = secular_roots(d1, z1, rho)
        m = len(d1)
        over = t[:, None] - delta  # root_i - d_j
        under = np.ones((m, m))
        i, j = np.indices((m, m))
        under[:-1] = np.where(i[:-1] < j[:-1], d1[:-1, None], d1[1:, None]) - d1[None, :]
        weight = np.sign(z1) * np.sqrt(np.abs(np.prod(over / under, axis=0)))
        w = weight[:, None] / -over.T
        w /= np.linalg.norm(w, axis=0)
        values, vectors = d.copy(), u.copy()
        values[keep], vectors[:, keep] = origin + t, u[:, keep] @ w
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]

    @staticmethod
    def deflated(d: np.ndarray, u: np.ndarray, z: np.ndarray, small: float) -> tuple[np.ndarray, np.ndarray]:
        """Turns the vectors of equal eigenvalues so that only the last of them has a part in z."""
        z, u = z.copy(), u.copy()
        for k in np.flatnonzero(np.diff(d) <= small).tolist():
            r = np.hypot(z[k], z[k + 1])
            if r and z[k]:
                c, s = z[k + 1] / r, z[k] / r
                u[:, k], u[:, k + 1] = c * u[:, k] - s * u[:, k + 1], s * u[:, k] + c * u[:, k + 1]
                z[k], z[k + 1] = 0.0, r
        return z, u


PARTS = "width int, n long, sums array<long>, body binary"


def parts_of(points: DataFrame, read: Callable[[int, np.ndarray, dict], None], body: Callable[[object], tuple[int, list[int], bytes]]) -> DataFrame:
    """A row for each partition and width of what `read` made of its vectors, with the partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, object] = {}
        for batch in batches:
            for width, x in by_width(batch.column(0)):
                read(width, x[1], state)
        rows = [{"width": width, **dict(zip(("n", "sums", "body"), body(s)))} for width, s in state.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("body", pa.binary())]))

    return points.select("x").mapInArrow(run, PARTS).withColumn("part", F.spark_partition_id())


def by_width(column: pa.ListArray) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Of each width: the places of its vectors in the batch, and these as a matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    for width in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == width)
        yield width, (at, flat[starts[at][:, None] + np.arange(width)[None, :]].astype(np.int64))


def together(parts: DataFrame, n: int, fold: Callable[[list[dict]], dict]) -> list[dict]:
    """Folds the parts of each width, FAN_IN at a time in a task, until one task can take the rest."""
    schema = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("body", pa.binary()), ("part", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        return pa.Table.from_pylist([fold(rows) | {"width": rows[0]["width"], "part": rows[0]["part"] // FAN_IN}], schema=schema)

    while n > 1:
        parts = materialize(parts.groupBy("width", F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(run, PARTS + ", part int"))
        n = -(-n // FAN_IN)
    return [r.asDict() for r in parts.collect()]  # one of each width


def spectra(points: DataFrame) -> dict[int, Spectrum]:
    """The spectrum of all points, by width."""

    def read(width: int, x: np.ndarray, state: dict) -> None:
        spectrum = state.setdefault(width, Spectrum(width))
        for row in x:
            spectrum.add(row)

    def pack(s: Spectrum) -> tuple[int, list[int], bytes]:
        return s.n, s.sums.tolist(), s.values.tobytes() + s.vectors.tobytes()

    def unpack(r: dict) -> Spectrum:
        s = Spectrum(r["width"])
        data = np.frombuffer(r["body"], float)
        s.n, s.sums = r["n"], np.array(r["sums"], np.int64)
        s.values, s.vectors = data[: r["width"]].copy(), data[r["width"] :].reshape(r["width"], r["width"]).copy()
        return s

    def fold(rows: list[dict]) -> dict:
        first = unpack(rows[0])
        for r in rows[1:]:
            first.merge(unpack(r))
        return dict(zip(("n", "sums", "body"), pack(first)))

    rows = together(materialize(parts_of(points, read, pack)), points.rdd.getNumPartitions(), fold)
    return {r["width"]: unpack(r) for r in rows}


def summed_squares(points: DataFrame, project: dict[int, Callable[[np.ndarray], np.ndarray]]) -> dict[int, np.ndarray]:
    """By width: the covariance of project(x) over all points, centred once more."""

    def read(width: int, x: np.ndarray, state: dict) -> None:
        y = project[width](x)
        n, first, second = state.get(width, (0, 0.0, 0.0))
        state[width] = (n + len(y), first + y.sum(axis=0), second + y.T @ y)

    def pack(s: tuple) -> tuple[int, list[int], bytes]:
        return s[0], [], np.asarray(s[1]).tobytes() + np.asarray(s[2]).tobytes()

    def fold(rows: list[dict]) -> dict:
        return {"n": sum(r["n"] for r in rows), "sums": [], "body": np.sum([np.frombuffer(r["body"], float) for r in rows], axis=0).tobytes()}

    out = {}
    for r in together(materialize(parts_of(points, read, pack)), points.rdd.getNumPartitions(), fold):
        data = np.frombuffer(r["body"], float)
        k = int((np.sqrt(1 + 4 * len(data)) - 1) / 2 + 0.5)
        mean = data[:k] / r["n"]
        out[r["width"]] = data[k:].reshape(k, k) / r["n"] - np.outer(mean, mean)
    return out


class Whitener:
    """n, sums, leading components, their eigenvalues and the trace, of one width."""

    def __init__(self, spectrum: Spectrum) -> None:
        self.n, self.sums = spectrum.n, spectrum.sums
        self.basis, _ = np.linalg.qr(spectrum.vectors)
        self.error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if len(x) and self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0)) >= 1 << 62:
            raise OverflowError("n times an entry doesn't fit a long")
        return self.n * x - self.sums

    def in_basis(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n) @ self.basis

    def refine(self, covariance: np.ndarray, k: int) -> None:
        """The Ritz pairs of the covariance in the basis."""
        values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
        self.trace = float(np.trace(covariance))
        order = np.argsort(-values, kind="stable")[:k]
        self.values, self.components = np.maximum(values[order], 0), self.basis @ turn[:, order]
        self.real = self.values > 64 * EPS * len(values) * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """By component; not a number where nothing varies."""
        y = (self.deviations(x) / self.n) @ self.components
        return np.divide(y, np.sqrt(self.values), out=np.full_like(y, np.nan), where=self.real[None, :])

    def checked(self, x: np.ndarray) -> np.ndarray:
        return self.whitened(x)[:, self.real]


def fit(points: DataFrame, k: int = 4) -> dict[int, Whitener]:
    """Whiteners by width, of a table of distinct vectors (x)."""
    out = {width: Whitener(s) for width, s in spectra(points).items() if width}
    if not out:
        return out
    points = points.where(F.size("x") > 0)
    for width, covariance in summed_squares(points, {w: m.in_basis for w, m in out.items()}).items():
        out[width].refine(covariance, k)
    for width, covariance in summed_squares(points, {w: m.checked for w, m in out.items()}).items():
        out[width].error = float(np.abs(covariance - np.eye(len(covariance))).max()) if len(covariance) else None
    return out


def whiten(rows: DataFrame, k: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row with a finite vector and component up to k: id, component, n, deviation, whitened, explained, identity_error."""
    found = whole_entries(rows.select(F.col(id_col), F.col(vec_col)), vec_col).select(F.col(id_col).alias("id"), "x")
    models = fit(materialize(found.select("x").distinct()), k)
    kind = dict(found.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "component", "n", "deviation", "whitened", "explained", "identity_error")
        for batch in batches:
            for width, (at, x) in by_width(batch.column(1)):
                if width not in models:
                    continue
                model = models[width]
                y, m = model.whitened(x), len(model.values)
                far = model.deviations(x)
                if width * float(np.abs(far).max(initial=0)) ** 2 >= 2.0**62:
                    square = [sum(v * v for v in row) for row in far.tolist()]
                else:
                    square = (far * far).sum(axis=1)
                repeat = np.repeat(np.arange(len(at)), m)
                share = model.values / model.trace if model.trace > 0 else np.full(m, np.nan)
                flat = y.ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at[repeat])), pa.array(np.tile(np.arange(1, m + 1), len(at)), pa.int32()), pa.array(np.full(len(repeat), model.n), pa.int64()),
                    pa.array(square, pa.int64()).take(pa.array(repeat)), pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(np.tile(share, len(at)), pa.float64(), mask=np.isnan(np.tile(share, len(at)))),
                    pa.array([model.error] * len(repeat), pa.float64()),
                ], names=names)

    out = found.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
