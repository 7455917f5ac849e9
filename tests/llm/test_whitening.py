"""Whitening: inertia and contour integration against a plain eigensolver, exact sums, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from sparkcurate.llm import whitening as H
from sparkcurate.llm.queries import op11_feast_whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    *[T.StructField(c, T.LongType()) for c in ("x", "i", "v", "n")],
])


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in vectors], SCHEMA).repartition(3)


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 40, 40) ** 2,
    "close": 5 + 1e-7 * np.arange(30.0),
    "equal": np.repeat([9.0, 4.0, 1.0], 15),
    "one": np.array([3.0]),
    "singular": np.concatenate([np.zeros(20), [1.0, 2.0, 5.0]]),
    "steep": 10.0 ** -np.arange(0, 12, 0.5),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_contours_find_every_component(name):
    m = matrix(SPECTRA[name])
    want = np.sort(SPECTRA[name])[::-1]
    for cut in (0.5 * want[0], 0.011 * want[0]):
        assert H.inertia(m, cut) == (want > cut).sum()
    found = H.slices(m, 32)
    assert sum(c for *_, c in found) >= min(32, (want > H.FLOOR * want.sum()).sum())
    for low, high, count in found:
        values, vectors = H.feast(m, low, high, count)
        inside = want[(want > low) & (want <= high)]
        assert len(values) == count == len(inside)
        assert np.allclose(np.sort(values)[::-1], inside, rtol=1e-9, atol=1e-12 * want[0])
        assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-10


def test_a_narrow_block_is_widened(monkeypatch):
    """A block too narrow for its interval loses pairs; the count says so and a wider one finds them."""
    real, widths = np.linalg.qr, []
    monkeypatch.setattr(np.linalg, "qr", lambda a: (widths.append(a.shape[1]), real(a))[1])
    # Nine eigenvalues just outside the interval pass the filter almost whole.
    near = np.concatenate([np.linspace(0.9, 1.0, 3), 1.0001 + 1e-5 * np.arange(9), np.linspace(30, 60, 10)])
    values, _ = H.feast(matrix(near), 0.85, 1.00005, 3)
    assert np.allclose(values, near[:3]) and len(set(widths)) > 1


def test_products_are_exact_at_any_size():
    draw = np.random.default_rng(1)
    for top in (3, 1 << 20, 1 << 30, 1 << 47):
        y = draw.integers(-top, top, (70, 4))
        assert (H.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_query_against_plain_linear_algebra(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    rows = op11_feast_whitening(spark, FOLDER).collect()
    x = {r.vec_id: [math.floor(64 * c) + 1_000_000 for c in r.embedding] for r in vectors}
    n, sums = len(x), [sum(c) for c in zip(*x.values())]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x.values()])
    cov = centred.T @ centred / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:32], basis[:, ::-1][:, :32]
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    got = np.zeros((n, 32))
    place = {v: i for i, v in enumerate(x)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-12
        assert r.identity_error < 1e-12
    want = centred @ basis / np.sqrt(values)
    want *= np.sign((want * got).sum(axis=0))
    assert np.abs(got - want).max() < 1e-7


def test_odd_vectors(spark):
    draw = np.random.default_rng(3)
    good = [(i, draw.standard_normal(4).tolist()) for i in range(60)]
    good += [good[7], good[7], (None, good[8][1])]  # repeated rows count again
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [math.nan] * 4), (104, [math.inf, 0.0, 0.0, 0.0]),
           (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    rows = table(spark, good + bad)
    model = H.fit(rows)
    assert model.n == 63 and len(model.values) == 4 and abs(sum(model.explained) - 1) < 1e-12
    out = H.transform(rows, model)
    assert out.columns == [*rows.columns, "white"] and out.count() == 63
    assert H.identity_error(rows, model) < 1e-10
    again = H.fit(rows.repartition(7))
    assert (again.vectors == model.vectors).all() and again.sums == model.sums
    large = H.fit(table(spark, [(i, [c * 1e9 for c in v]) for i, v in good]))
    assert large.project(np.array([[math.floor(6.4e10 * c) + 10**6 for c in good[0][1]]]))[0] == [None]  # beyond a long


def test_constant_few_and_no_vectors(spark):
    same = table(spark, [(i, [1.0, 2.0]) for i in range(5)])
    for rows in (same, table(spark, [(1, [1.0])]), table(spark, []), table(spark, [(1, None)])):
        model = H.fit(rows)
        assert len(model.values) == 0 and H.identity_error(rows, model) == 0.0
        assert all(r.white.whitened == [] for r in H.transform(rows, model).collect())
    two = H.fit(table(spark, [(0, [0.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0])]))
    assert len(two.values) == 1 and abs(abs(two.vectors[0, 0]) - 1) < 1e-15
