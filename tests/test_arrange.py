"""Array manipulation against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import arrange as ar
from gridloom.operators import linalg
from gridloom.operators.frame import NdFrame
from gridloom.sources import npy

A = np.arange(24.0).reshape(2, 3, 4) - 5


@pytest.fixture(scope="module")
def make(spark):
    return lambda a: NdFrame(npy.from_array(spark, np.asarray(a, float)), np.asarray(a).shape)


def same(got, expected):
    assert got.shape == expected.shape
    assert got.cells.count() == expected.size
    np.testing.assert_array_equal(npy.to_array(got.cells, got.shape), expected)


def test_axes(make):
    a = make(A)
    same(ar.moveaxis(a, 0, -1), np.moveaxis(A, 0, -1))
    same(ar.moveaxis(a, [0, 2], [2, 0]), np.moveaxis(A, [0, 2], [2, 0]))
    for axis in range(3):
        for start in (-1, 0, 1, 2, 3):
            assert ar.rollaxis(a, axis, start).shape == np.rollaxis(A, axis, start).shape
    same(ar.rollaxis(a, 2, 1), np.rollaxis(A, 2, 1))
    same(ar.swapaxes(a, 0, -1), np.swapaxes(A, 0, -1))
    same(ar.squeeze(make(A[:1])), np.squeeze(A[:1]))
    with pytest.raises(ValueError, match="squeezed"):
        ar.squeeze(a, 0)
    for k in range(-1, 5):
        same(ar.rot90(make(A[0]), k), np.rot90(A[0], k))
    same(ar.rot90(a, 1, (2, 0)), np.rot90(A, 1, (2, 0)))
    same(ar.broadcast_to(make(A[0, :1]), (2, 3, 4)), np.broadcast_to(A[0, :1], (2, 3, 4)))
    with pytest.raises(ValueError, match="broadcast"):
        ar.broadcast_to(a, (2, 3, 5))


def test_reshape_checks(make):
    a = make(A[0])
    same(a.reshape((2, -1)), A[0].reshape(2, -1))
    same(a.reshape((12, 1)), A[0].reshape(12, 1))
    for shape in ((2, 2), (5, -1), (-1, -1), (0, -1)):
        with pytest.raises(ValueError, match="fill|one length"):
            a.reshape(shape)


@pytest.mark.parametrize("cut", [(1, 3, 1), (None, None, -1), (-1, None, -2), (5, 0, -1), (3, 1, 1), (-3, -1, 1), (0, 9, 3)])
def test_slices(make, cut):
    same(make(A).slice(2, *cut), A[:, :, slice(*cut)])


def test_join_and_split(make):
    m = make(A[0])
    same(ar.vstack(m, m), np.vstack([A[0], A[0]]))
    same(ar.hstack(m, m), np.hstack([A[0], A[0]]))
    same(ar.dstack(m, m), np.dstack([A[0], A[0]]))
    same(ar.column_stack(make(A[0, 0]), make(A[0, 1])), np.column_stack([A[0, 0], A[0, 1]]))
    same(ar.block([[m, m], [m, m]]), np.block([[A[0], A[0]], [A[0], A[0]]]))
    for parts in (2, 3, [1, 3]):
        for got, expected in zip(ar.array_split(m, parts, 1), np.array_split(A[0], parts, 1), strict=True):
            same(got, expected)
    with pytest.raises(ValueError, match="equal"):
        ar.split(m, 3, 1)
    with pytest.raises(ValueError, match="differ"):
        m.concatenate(make(A[0, :, :2]), 0)
    same(ar.append(m, m), np.append(A[0], A[0]))
    same(ar.append(m, m, 1), np.append(A[0], A[0], 1))


def test_insert_and_delete(make):
    m = make(A[0])
    same(ar.insert(m, 1, 7.0, 1), np.insert(A[0], 1, 7.0, 1))
    same(ar.insert(m, [0, 4, 1, 1], 7.0, 1), np.insert(A[0], [0, 4, 1, 1], 7.0, 1))
    new = np.arange(9.0).reshape(3, 3) + 100
    same(ar.insert(m, [3, 0, 3], make(new), 1), np.insert(A[0], [3, 0, 3], new, 1))
    same(ar.delete(m, [0, -1], 1), np.delete(A[0], [0, -1], 1))
    same(ar.delete(m, 1), np.delete(A[0], 1, 0))
    with pytest.raises(IndexError):
        ar.delete(m, 9)


@pytest.mark.parametrize("mode", ["constant", "edge", "reflect", "symmetric", "wrap"])
@pytest.mark.parametrize("widths", [1, ((2, 0), (1, 3)), ((7, 8), (0, 9))])
def test_pad(make, mode, widths):
    same(ar.pad(make(A[0]), widths, mode), np.pad(A[0], widths, mode))


def test_making(make, spark):
    x, y, z = np.array([1.0, 2, 3]), np.array([5.0, 6]), np.array([8.0])
    for indexing in ("xy", "ij"):
        for got, expected in zip(ar.meshgrid(make(x), make(y), make(z), indexing=indexing), np.meshgrid(x, y, z, indexing=indexing), strict=True):
            same(got, expected)
    for got, expected in zip(ar.indices(spark, (2, 3)), np.indices((2, 3)), strict=True):
        same(got, expected)
    same(ar.tri(spark, 3, 4, 1), np.tri(3, 4, 1))
    same(ar.vander(make(x), 4), np.vander(x, 4))
    same(ar.vander(make(x), increasing=True), np.vander(x, increasing=True))
    same(ar.diagflat(make(x), -1), np.diagflat(x, -1))
    for got, expected in ((ar.logspace(spark, 0, 3, 7), np.logspace(0, 3, 7)), (ar.geomspace(spark, -1, -1000, 4), np.geomspace(-1, -1000, 4))):
        np.testing.assert_allclose(npy.to_array(got.cells, got.shape), expected, rtol=1e-13)
    same(ar.resize(make(A[0]), (5, 7)), np.resize(A[0], (5, 7)))
    same(ar.resize(make(A[0]), (2, 2)), np.resize(A[0], (2, 2)))


def test_find_and_scatter(make):
    m, mask = make(A[0]), (A[0] % 3 == 0).astype(float)
    at = np.array([[0, 3], [1, -1], [2, 2]])
    same(ar.ix_(m, make([2, 0]), make([1, 1, 3])), A[0][np.ix_([2, 0], [1, 1, 3])])
    expected = A[0].copy()
    np.put_along_axis(expected, at, at * 10.0, 1)
    same(ar.put_along_axis(m, make(at), make(at * 10.0), 1), expected)
    for f, g in ((ar.putmask, np.putmask), (ar.place, np.place)):
        expected = A[0].copy()
        g(expected, mask.astype(bool), [100.0, 200.0, 300.0])
        same(f(m, make(mask), [100.0, 200.0, 300.0]), expected)
    expected = A[0].copy()
    np.copyto(expected, A[0, 1] * 2, where=mask.astype(bool))
    same(ar.copyto(m, make(A[0, 1] * 2), make(mask)), expected)
    expected = A[0].copy()
    np.fill_diagonal(expected, 9.0)
    same(ar.fill_diagonal(m, 9.0), expected)
    assert sorted(r["v"] for r in ar.extract(make(mask), m).collect()) == sorted(np.extract(mask, A[0]))
    assert sorted(r["i0"] for r in ar.flatnonzero(m).collect()) == np.flatnonzero(A[0]).tolist()
    same(ar.compress(m, [True, False, True], 0), np.compress([True, False, True], A[0], 0))
    same(ar.trim_zeros(make([0.0, 0, 1, 0, 2, 0])), np.trim_zeros(np.array([0.0, 0, 1, 0, 2, 0])))
    row = m.cells.select(*[c.alias(f"c{k}") for k, c in enumerate(ar.unravel_index(m.flat(), (3, 4)))], "i0", "i1").collect()
    assert all((r["c0"], r["c1"]) == (r["i0"], r["i1"]) for r in row)


def test_einsum_ellipsis_and_stretch(make):
    a, b = np.random.default_rng(1).normal(size=(2, 3, 4)), np.random.default_rng(2).normal(size=(4, 5))
    for text, args in (("...ij,jk->...ik", (a, b)), ("...j,jk", (a, b)), ("i...->...", (a,)), ("...ij->...ji", (a,)), ("...,...", (a, a[:1])), ("ij,jk", (b.T, b))):
        got = linalg.einsum(text, *[make(x) for x in args])
        np.testing.assert_allclose(npy.to_array(got.cells, got.shape), np.einsum(text, *args), rtol=1e-12, atol=1e-12)
    with pytest.raises(ValueError, match="labels"):
        linalg.einsum("ijk...,->", make(b), make(np.array([1.0])))


@pytest.mark.parametrize(("n", "k", "m", "block", "tile"), [(7, 9, 5, 2, 2), (3, 20, 3, 4, 1), (10, 3, 11, 3, 8)])
def test_block_products(make, n, k, m, block, tile):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, k)), rng.normal(size=(k, m))
    got = linalg.block_matmul(make(x), make(y), block, tile)
    np.testing.assert_allclose(npy.to_array(got.cells, got.shape), x @ y, rtol=1e-12, atol=1e-12)


def test_outer_is_bounded(make, monkeypatch):
    from gridloom.operators import frame

    monkeypatch.setattr(frame, "MAX_OUTER", 3)
    with pytest.raises(ValueError, match="outer product"):
        linalg.outer(make(np.arange(9.0)), make(np.arange(5.0)))
    same(linalg.outer(make(np.arange(3.0)), make(np.arange(5.0))), np.outer(np.arange(3.0), np.arange(5.0)))


def test_gram_refuses_other_lengths(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0],)], "v array<double>")
    with pytest.raises(Exception, match="hasn't 2 elements"):
        linalg.gram(df, "v", 2).collect()
    ok = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert {(r["i0"], r["i1"]): r["v"] for r in linalg.gram(ok, "v", 2).collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 2.0, (1, 1): 4.0}


def test_reductions_of_truth(spark):
    from gridloom.operators import reduce

    df = spark.createDataFrame([(1, 0.0), (1, 2.0), (2, float("nan")), (3, 0.0), (4, None)], "g int, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in reduce.reduce_by(df, ["g"], a=reduce.all_true("v"), b=reduce.any_true("v")).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (False, False), 4: (True, False)}
    assert df.limit(0).agg(reduce.all_true("v"), F.coalesce(reduce.any_true("v"), F.lit(False))).first()[:] == (True, False)
