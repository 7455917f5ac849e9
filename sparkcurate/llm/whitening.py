"""Embedding whitening: leading components of the covariance by contour integration (FEAST).

``fit`` turns every entry c of the vectors into the whole number floor(64 c) + 1000000, sums the numbers and
their products exactly, and so has the covariance correctly rounded in every entry, in whatever order the
tasks end. ``transform`` centres vectors, projects them on the components and divides by the roots of
the eigenvalues.

Components, after Polizzi's FEAST: the spectrum is sliced into intervals of a few eigenvalues. How many lie
above a cut is the inertia of the shifted matrix, read off its LDL^T factors; cuts are placed in the widest
gap found. Per interval a block of vectors is filtered by the Gauss-Legendre quadrature of the resolvent
around a circle through both ends (complex shifted solves), and Rayleigh-Ritz in the filtered space gives the
eigenpairs. An interval is done when it holds as many converged pairs as its inertia count says; if one is
missing, it is filtered again from a wider block, at last from one as wide as the matrix.

Scale: vectors are read in place three times (sums, products, measure) and never shuffled; tasks hand on d
sums and d * (d + 1) / 2 products for d dimensions, added up by Spark. Only tables of that size, which the
number of rows does not change, meet in the driver or are sent to the tasks that solve the intervals.

Defined results: rows with a null or empty vector, a null or non-finite entry, an entry beyond 2 ** 46 in size, or
another length than most vectors (ties: the longer) are left out; repeated rows count as often as
they occur. Directions without variance have no component, so fewer than ``components`` come out of
constant, few or short vectors, and none of an empty table. Equal eigenvalues get one basis of their
space, the same for all rows. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Eigenvalues an interval is to hold, quadrature points on the half circle, and probes for a gap.
SLICE = 8
NODES = 8
PROBES = 15
#: Part of the trace below which an eigenvalue counts as none.
FLOOR = 1e-13
WHOLE = "decimal(38,0)"
LIMB = 1 << 23


def grid(vector: str = "embedding") -> Column:
    """The vector in whole numbers; null where it takes no part."""
    entries = F.col(vector).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > 2.0**46)
    whole = F.transform(entries, lambda c: F.floor(c * 64) + 1_000_000)
    return F.when(entries.isNotNull() & (F.size(entries) > 0) & ~F.exists(entries, bad), whole)


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _added(x: np.ndarray) -> np.ndarray:
    """Exact column sums, as Python's whole numbers."""
    few = max(1, (1 << 62) // max(1, int(np.abs(x).max())))
    return sum(x[at : at + few].sum(axis=0).astype(object) for at in range(0, len(x), few))


def products(y: np.ndarray) -> np.ndarray:
    """Exact ``y.T @ y`` of whole numbers: limbs small enough that doubles hold every partial sum."""
    top = int(np.abs(y).max(initial=0))
    if top < LIMB:
        few, total = (1 << 53) // max(1, top * top), 0
        for at in range(0, len(y), few):
            part = y[at : at + few].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
        return total
    high, low = np.divmod(y + LIMB // 2, LIMB)
    low -= LIMB // 2
    both = np.concatenate([high, low], axis=1)
    if int(np.abs(high).max()) >= LIMB:
        both = both.astype(object)
        whole = both.T @ both
    else:
        whole = products(both)
    d = y.shape[1]
    return whole[:d, :d] * LIMB * LIMB + (whole[:d, d:] + whole[d:, :d]) * LIMB + whole[d:, d:]


def _cells(values: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(values))
    sums = pa.array([Decimal(int(v)) for v in values[i, j]], pa.decimal128(38, 0))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), sums], ["i", "j", "v"])


def inertia(matrix: np.ndarray, cut: float) -> int:
    """Eigenvalues above ``cut``: the positive ones of D in LDL^T, pivoted after Bunch and Parlett."""
    a = matrix - cut * np.eye(len(matrix))
    above = 0
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        p = int(diagonal.argmax())
        r, s = divmod(int(off.argmax()), len(a))
        if diagonal[p] == 0 and off[r, s] == 0:
            break
        if diagonal[p] >= 0.64 * off[r, s]:
            out = [p]
            above += int(a[p, p] > 0)
        else:  # a pair of pivots of either sign
            out = [r, s]
            above += 1
        rest = np.setdiff1d(np.arange(len(a)), out)
        side = a[np.ix_(rest, out)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(out, out)], side.T)
        a = (a + a.T) / 2
    return above


def slices(matrix: np.ndarray, components: int) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues between)`` from the largest on, until ``components`` are covered."""
    trace = float(np.trace(matrix))
    bottom, top = FLOOR * trace, float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-12)
    most = inertia(matrix, bottom) if trace > 0 else 0
    open_ones, done, covered = [(bottom, top, 0, most)] if most else [], [], 0
    while open_ones and covered < components:
        low, high, above, upto = open_ones.pop()
        if upto - above <= SLICE or high - low <= 1e-9 * top:
            done.append((low, high, upto - above))
            covered += upto - above
            continue
        probes = np.linspace(low, high, PROBES + 2)[1:-1]
        counts = [inertia(matrix, x) for x in probes]
        # The longest run of probes with one count is the widest gap; of equal ones that nearest to the middle.
        runs = [np.flatnonzero(np.array(counts) == c) for c in dict.fromkeys(counts) if above < c < upto]
        if runs:
            run = max(runs, key=lambda r: (len(r), -abs(r.mean() - PROBES // 2)))
            cut, count = float((probes[run[0]] + probes[run[-1]]) / 2), counts[run[0]]
            open_ones += [(low, cut, count, upto), (cut, high, above, count)]
        else:  # all lie between two neighbouring probes, or beyond the last ones
            inner = [low, *(x for x, c in zip(probes, counts) if c == upto)][-1], [*(x for x, c in zip(probes, counts) if c == above), high][0]
            open_ones.append((float(inner[0]), float(inner[1]), above, upto))
    return done


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs between ``low`` and ``high``."""
    d = len(matrix)
    x, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 - x))
    shifted = (middle + radius * turn)[:, None, None] * np.eye(d) - matrix
    draw = np.random.default_rng(count)
    width = min(d, count + max(4, count // 2))
    scale = max(abs(low), abs(high))
    while True:
        block, best = draw.standard_normal((d, width)), np.inf
        while True:
            solved = np.linalg.solve(shifted, np.broadcast_to(block, (NODES, *block.shape)))
            filtered = np.einsum("k,kij->ij", weights / 2 * radius * turn, solved).real
            basis = np.linalg.qr(filtered)[0]
            values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ inner
            inside = (values > low) & (values <= high)
            error = np.abs(matrix @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0)
            if error >= best / 2:  # it no longer falls
                break
            best = error
        if int(inside.sum()) == count and error <= 1e-11 * scale or width == d:
            return values[inside], block[:, inside]
        width = min(d, 2 * width)


@dataclass
class Whitening:
    """What ``fit`` has found: whole sums, and a column for each component by falling eigenvalue."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]

    def project(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """``sum((n x - S) ** 2)``, null where a long cannot hold it, and the whitened vectors."""
        centre = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        y = x - centre
        if (self.n * (int(np.abs(y).max(initial=0)) + 1)) ** 2 * y.shape[1] < 1 << 63:
            away = self.n * y - rest.astype(np.int64)
            spread = (away * away).sum(axis=1).tolist()
        else:
            spread = ((self.n * y.astype(object) - rest) ** 2).sum(axis=1)
            spread = [v if v < 1 << 63 else None for v in spread]
        z = y - np.array([r / self.n for r in rest])
        return spread, z @ self.vectors / np.sqrt(self.values)


def _usable(rows: DataFrame, vector: str) -> tuple[DataFrame, int, int]:
    """The whole-number vectors of the most frequent length, that length, and their number."""
    whole = rows.select(grid(vector).alias("x")).filter("x is not null")
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (found.d, found.n) if found else (0, 0)
    return whole.filter(F.size("x") == d), d, n


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Sums, covariance and leading components of all usable vectors of ``rows``."""
    spark = rows.sparkSession
    whole, d, n = _usable(rows, vector)
    if not n:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(map(_added, _matrices(batches, d)))
        if not isinstance(total, int):
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), values], ["i", "v"])

    added = whole.mapInArrow(sums, f"i int, v {WHOLE}").groupBy("i").agg(F.sum("v").alias("v"))
    total = [int(r.v) for r in sorted(added.collect())]
    centre = np.array([s // n for s in total], np.int64)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(products(x - centre) for x in _matrices(batches, d))
        if not isinstance(total, int):
            yield _cells(total)

    cells = whole.mapInArrow(squares, f"i int, j int, v {WHOLE}").groupBy("i", "j").agg(F.sum("v").alias("v"))
    matrix, trace = np.zeros((d, d)), Fraction(0)
    rest = [s % n for s in total]
    for i, j, v in cells.toLocalIterator():
        exact = n * int(v) - rest[i] * rest[j]
        matrix[i, j] = matrix[j, i] = exact / (n * n)
        trace += Fraction(exact, n * n) if i == j else 0
    found = slices(matrix, components)
    if not found:
        return Whitening(n, total, float(trace), np.zeros(0), np.zeros((d, 0)))
    shared = spark.sparkContext.broadcast(matrix)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for low, high, count in part.itertuples(index=False):
                values, vectors = feast(shared.value, low, high, count)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    todo = spark.createDataFrame(found, "low double, high double, count int").repartition(len(found), "low")
    pairs = sorted(todo.mapInPandas(solve, "value double, vector array<double>").collect(), reverse=True)
    missing = sum(count for *_, count in found) - len(pairs)
    if missing:
        raise ArithmeticError(f"{missing} eigenvalues that the inertia counts were not found")
    # One Rayleigh-Ritz over all intervals makes their vectors orthogonal to the last bit.
    basis = np.linalg.qr(np.array([p.vector for p in pairs]).T)[0]
    values, inner = np.linalg.eigh(basis.T @ matrix @ basis)
    vectors = (basis @ inner)[:, ::-1][:, :components]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, total, float(trace), values[::-1][:components], vectors)


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding", out: str = "white") -> DataFrame:
    """The rows that take part, with ``out``: a struct of ``deviation`` and the ``whitened`` vector."""
    d = len(model.sums)

    @F.arrow_udf("struct<deviation:bigint,whitened:array<double>>")
    def project(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            spread, white = model.project(part.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel(), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(spread, pa.int64()), lists], ["deviation", "whitened"])

    usable = F.size(F.coalesce(grid(vector), F.array().cast("array<bigint>"))) == d
    if not d:
        return rows.filter("false").withColumn(out, F.lit(None).cast("struct<deviation:bigint,whitened:array<double>>"))
    return rows.filter(usable).withColumn(out, project(grid(vector)))


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest entry, in size, of the whitened rows' covariance minus the identity."""
    d, k = len(model.sums), len(model.values)
    if not k:
        return 0.0
    exact = "decimal(38,15)"  # sums in one order or another are the same

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for x in _matrices(batches, d):
            white = model.project(x)[1]
            total += np.vstack([white.T @ white, white.sum(axis=0)])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    whole = rows.select(grid(vector).alias("x")).filter(F.size("x") == d)
    cells = whole.mapInArrow(measure, "i int, j int, v double").groupBy("i", "j").agg(F.sum(F.col("v").cast(exact)).alias("v"))
    total = np.zeros((k + 1, k))
    for i, j, v in cells.collect():
        total[i, j] = float(v) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
