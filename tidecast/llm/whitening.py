"""Embedding whitening: principal components of the distinct vectors by spectrum slicing.

The sums and products of the distinct vectors, in whole numbers and so exact in any order, are added up by
Spark; the driver gets one matrix of the dimensions. There LDL' factorisations of the shifted
covariance count the eigenvalues above a shift (Sylvester's law of inertia), bisection isolates each leading
one, and Rayleigh quotient iteration converges to it cubically. Counts on both sides of each
eigenvalue found certify its number. A pass over the vectors projects them.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

STEP = 64
SHIFT = 1_000_000
#: floor(64 * c) is held within these bounds, so that whole numbers are exact as doubles.
LARGEST = 1 << 40
COMPONENTS = 16
#: Rows of a block of a task.
BLOCK = 4096


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of (positive, zero) eigenvalues of the symmetric ``a``, from the pivots of its LDL' factorisation.

    Pivots are of one or two rows, chosen by Bunch and Kaufman's rule, so that the factors stay small.
    """
    a = a.copy()
    n, k, positive, zero, alpha = len(a), 0, 0, 0, (1 + 17**0.5) / 8
    tiny = np.finfo(float).tiny
    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        most = column.max(initial=0.0)
        size = 1
        if max(abs(a[k, k]), most) <= tiny:
            zero, k = zero + 1, k + 1
            continue
        if abs(a[k, k]) < alpha * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            sigma = row.max()
            if abs(a[k, k]) * sigma < alpha * most * most:
                at = k if abs(a[r, r]) >= alpha * sigma else k + 1
                size = 1 if at == k else 2
                if at != r:
                    a[[at, r], k:] = a[[r, at], k:]
                    a[k:, [at, r]] = a[k:, [r, at]]
        block, below = a[k : k + size, k : k + size], a[k + size :, k : k + size]
        if size == 1:
            positive += int(block[0, 0] > 0)
            a[k + 1 :, k + 1 :] -= np.outer(below, below / block[0, 0])
        else:  # such a pivot has one eigenvalue of each sign
            positive += 1
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(block, below.T)
        k += size
    return positive, zero


class Spectrum:
    """Leading eigenpairs of a symmetric matrix, numbered from the largest."""

    def __init__(self, a: np.ndarray):
        self.a, self.counts = (a + a.T) / 2, {}
        self.norm = float(np.abs(self.a).sum(1).max(initial=0.0))
        self.eps = np.finfo(float).eps * max(self.norm, np.finfo(float).tiny)
        self.values: list[float] = []
        self.vectors = np.zeros((len(a), 0))

    def above(self, shift: float) -> int:
        """How many eigenvalues lie above ``shift``."""
        if shift not in self.counts:
            self.counts[shift] = inertia(self.a - shift * np.eye(len(self.a)))[0]
        return self.counts[shift]

    def isolated(self, k: int) -> tuple[float, float, bool]:
        """Bounds that hold the k-th eigenvalue, and whether no other one (else they are as near as doubles tell apart)."""
        low, high = -2 * self.norm, 2 * self.norm
        for shift, n in self.counts.items():  # what is known already
            low, high = (max(low, shift), high) if n >= k else (low, min(high, shift))
        while self.above(high) != k - 1 or self.above(low) != k:
            middle = (low + high) / 2
            if high - low <= 8 * self.eps or not low < middle < high:
                return low, high, False
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
        return low, high, True

    def next(self) -> bool:
        """Find one more pair; False if the eigenvalue is zero within rounding."""
        k = len(self.values) + 1
        low, high, alone = self.isolated(k)
        while True:
            value, v = self.iterate(low, high, k)
            if not alone or low - 8 * self.eps <= value <= high + 8 * self.eps:
                break
            middle = (low + high) / 2  # went to a neighbour: nearer bounds
            if not low < middle < high:
                break
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        width = 64 * len(self.a) * self.eps
        if value <= width:
            return False
        if not (self.above(value - width) >= k > self.above(value + width)):
            raise ArithmeticError(f"eigenvalue {k} is not certified")
        self.values.append(value)
        self.vectors = np.column_stack([self.vectors, v * np.sign(v[np.abs(v).argmax()])])
        return True

    def iterate(self, low: float, high: float, k: int) -> tuple[float, np.ndarray]:
        """Inverse iteration at the middle of the bounds, then Rayleigh quotient iteration to the end."""
        v = self.unit(np.random.default_rng(k).normal(size=len(self.a)))
        shift, best = (low + high) / 2, (np.inf, 0.0, v)
        for step in range(60):
            v = self.unit(self.solved(shift, v))
            value = float(v @ self.a @ v)
            rest = float(np.linalg.norm(self.a @ v - value * v))
            if rest < best[0]:
                best = (rest, value, v)
            elif step > 8 and best[0] <= 64 * self.eps:
                break
            # quotients count once they are certain to belong to these bounds
            shift = value if low < value < high and rest < min(value - low, high - value) else shift
            if rest <= self.eps:
                break
        return best[1], best[2]

    def solved(self, shift: float, v: np.ndarray) -> np.ndarray:
        for nudge in (0.0, self.eps, 3 * self.eps, 17 * self.eps):
            try:
                z = np.linalg.solve(self.a - (shift + nudge) * np.eye(len(v)), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(z).all():
                return z
        return v

    def unit(self, v: np.ndarray) -> np.ndarray:
        """``v`` of length 1, orthogonal to the vectors found."""
        v = v / np.abs(v).max()
        for _ in range(2):
            v = v - self.vectors @ (self.vectors.T @ v)
        return v / np.linalg.norm(v)


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero by falling size, ``most`` at most, and their unit vectors as columns."""
    found = Spectrum(a)
    while len(found.values) < min(most, len(a)) and found.next():
        pass
    return np.array(found.values), found.vectors


def vectors(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: the rounded entries of complete vectors as bytes (32-bit numbers where all fit, else 64-bit ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, ends = column.flatten(), np.asarray(column.offsets)
            sizes = np.diff(ends)
            values = flat.to_numpy(zero_copy_only=False).astype(float)  # nulls become NaN
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            starts = ends - ends[0]
            good = (bad[starts[1:]] == bad[starts[:-1]]) & (sizes > 0) & column.is_valid().to_numpy(zero_copy_only=False)
            y = np.clip(np.floor(STEP * np.where(np.isfinite(values), values, 0)), -LARGEST, LARGEST).astype(np.int64)
            rows = np.flatnonzero(good)
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([packed(y[starts[i] : starts[i + 1]]) for i in rows.tolist()], pa.binary())], names=["vec_id", "x"])

    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("v is not null").mapInArrow(run, "vec_id long, x binary")


def packed(y: np.ndarray) -> bytes:
    """A mark of the width, then the numbers; equal vectors give equal bytes."""
    narrow = len(y) and -(1 << 31) <= y.min() and y.max() < 1 << 31
    return (b"\4" + y.astype("<i4").tobytes()) if narrow else (b"\10" + y.astype("<i8").tobytes())


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, f"<i{b[0]}", offset=1) for b in rows]).astype(np.int64)


def dimensions(x: str = "x") -> Column:
    return (F.length(x) - 1) / F.when(F.hex(F.substring(x, 1, 1)) == "04", F.lit(4)).otherwise(F.lit(8))


def products(z: np.ndarray) -> np.ndarray:
    """z'z of whole numbers as whole numbers, exactly."""
    largest = int(np.abs(z).max(initial=0))
    step = (1 << 53) // max(1, largest * largest)
    if step < 1:
        return z.T.astype(object) @ z.astype(object)
    parts = [(z[a : a + step].T.astype(float) @ z[a : a + step].astype(float)) for a in range(0, len(z), max(1, step))]
    return sum((p.astype(np.int64).astype(object) for p in parts), np.zeros((z.shape[1],) * 2, object))


def added(rows: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sum of z'z over ``rows`` (column ``x``), z being the vector less ``centre``, with a last entry of 1: products, sums and number."""
    d = len(centre) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            items = batch.column(0)
            for lo in range(0, len(items), BLOCK):
                x = unpacked(items.slice(lo, BLOCK).to_pylist()) - centre
                total += products(np.column_stack([x, np.ones(len(x), np.int64)]))
        if total[-1, -1]:
            # 30 bits and the rest, each sum far from the bounds of a long
            rows = [[int(v) for v in total[i, i:]] for i in range(d)]
            yield pa.record_batch(
                [pa.array(range(d), pa.int32()), pa.array([[v >> 30 for v in r] for r in rows], pa.list_(pa.int64())), pa.array([[v & (1 << 30) - 1 for v in r] for r in rows], pa.list_(pa.int64()))], names=["i", "hi", "lo"]
            )

    entries = rows.select("x").mapInArrow(run, "i int, hi array<long>, lo array<long>")
    entries = entries.select("i", F.posexplode(F.arrays_zip("hi", "lo")).alias("j", "v")).groupBy("i", "j").agg(F.sum("v.hi").alias("hi"), F.sum("v.lo").alias("lo"))
    out = np.zeros((d, d), object)
    for r in entries.collect():  # one number for each pair of dimensions
        out[r["i"], r["i"] + r["j"]] = out[r["i"] + r["j"], r["i"]] = (int(r["hi"]) << 30) + int(r["lo"])
    return out


class Whitening:
    """What the fit list says: ``n``, exact ``sums``, components (columns) and their eigenvalues, and the ``trace``."""

    def __init__(self, total: np.ndarray, centre: np.ndarray, most: int):
        self.n, near, cross = int(total[-1, -1]), [int(v) for v in total[-1, :-1]], total[:-1, :-1]
        self.sums = [s + self.n * int(c) for s, c in zip(near, centre)]
        square = self.n * self.n
        d = len(near)
        covariance = np.array([[float(Fraction(self.n * int(cross[i, j]) - near[i] * near[j], square)) if j >= i else 0.0 for j in range(d)] for i in range(d)])
        self.covariance = np.triu(covariance) + np.triu(covariance, 1).T
        self.trace = float(np.trace(self.covariance))
        self.values, self.vectors = leading(self.covariance, most)
        self.scaled = self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S exactly, as objects where longs could overflow, and x - S / n)."""
        sums = np.array(self.sums, object)
        largest = (int(np.abs(x).max(initial=0)) + 1) * self.n + max(map(abs, self.sums), default=0)
        wide = x.astype(object) * self.n - sums if len(sums) * largest * largest >= 1 << 62 else x * np.int64(self.n) - sums.astype(np.int64)
        return wide, wide.astype(float) / self.n


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each complete vector and component.

    An entry c counts as floor(64 c) + 1,000,000 (64 c beyond 2^40 as 2^40). Vectors that are null, empty or hold null or
    non-finite entries are dropped, and so are those of other lengths than most have (of equally many, the longer). Every distinct vector counts once in the
    fit. ``deviation`` is the sum of (n x - S)^2 over the dimensions, null beyond the range of a long. Components without variance (within rounding) are
    left out, so a single distinct vector gives no rows, as does an empty table. Repeated rows and null ids stay; other columns are ignored.
    Equal eigenvalues have any orthonormal vectors of their space, the same for all rows.
    """
    rows = cut(vectors(embeddings, id_col, vector_col))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = rows.groupBy(dimensions().cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d = int(sizes["d"])
    rows = rows.where(dimensions() == d)
    fit = cut(rows.select("x").distinct())
    # near the mean, so that products stay small; what they are taken around does not change the result
    some = fit.limit(64).collect()
    centre = np.round(unpacked([bytes(r["x"]) for r in some]).mean(0)).astype(np.int64)
    model = Whitening(added(fit, centre), centre, components)
    k = len(model.values)
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                w = model.centred(unpacked(batch.column(0).slice(lo, BLOCK).to_pylist()))[1] @ model.scaled
                w = np.column_stack([w, np.ones(len(w))])
                total += w.T @ w
        if total[-1, -1]:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    sums = np.zeros((k + 1) ** 2)
    for r in fit.mapInArrow(gram, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # (components + 1)^2 numbers
        sums[r["at"]] = r["v"]
    sums = sums.reshape(k + 1, k + 1) / model.n
    error = float(np.abs(sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                wide, x = model.centred(unpacked(part.column(1).to_pylist()))
                deviation = (wide * wide).sum(1)
                if deviation.dtype == object:
                    deviation = pa.array([v if v < 1 << 63 else None for v in map(int, deviation)], pa.int64())
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.record_batch(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(deviation).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array((x @ model.scaled).ravel())],
                    names=["vec_id", "component", "deviation", "whitened"],
                )

    explained = F.element_at(F.array(*(F.lit(float(e / model.trace)) for e in model.values)), F.col("component"))
    out = rows.mapInArrow(run, "vec_id long, component int, deviation long, whitened double")
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
