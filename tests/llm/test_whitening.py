"""Whitening against a dense eigensolver; inertia, close and equal eigenvalues; odd rows."""

import numpy as np
import pytest

from tidecast.llm import registry, whitening


def test_inertia_counts_signs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 17, 40):
        for _ in range(20):
            a = rng.normal(size=(n, n))
            a = a + a.T
            if rng.random() < 0.3:
                a[np.diag_indices(n)] = 0  # needs pivots of two rows
            assert whitening.inertia(a)[0] == (np.linalg.eigvalsh(a) > 0).sum()
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3)


@pytest.mark.parametrize("values", [np.arange(40.0, 0, -1), 2.0 ** -np.arange(30), np.r_[5.0, 5 - 1e-12, 5 - 2e-12, 1.0, 1, 1, 0.5, 1e-3], np.r_[1e9, 1e-3, 1e-4], np.ones(6), np.r_[3.0, 2, 1, 0, 0]])
def test_leading_pairs(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    a = (q * values) @ q.T
    got, v = whitening.leading(a, 16)
    size = values.max()
    want = np.sort(np.linalg.eigvalsh((a + a.T) / 2))[::-1][:16]
    want = want[want > 64 * len(a) * np.finfo(float).eps * np.abs(a).sum(1).max()]
    assert len(got) == len(want) and np.abs(got - want).max() < 1e-13 * size * len(values)
    assert np.abs(v.T @ v - np.eye(len(got))).max() < 1e-12 and np.abs(a @ v - v * got).max() < 1e-12 * size


def test_exact_products():
    rng = np.random.default_rng(2)
    for top in (100, 1 << 28, 1 << 40):
        z = rng.integers(-top, top, (50, 4))
        assert (whitening.products(z) == z.T.astype(object) @ z.astype(object)).all()


def expected(rows, most=16):
    x = [(i, np.floor(64 * np.array(v, float)).astype(int) + 1_000_000) for i, v in rows if v is not None and all(e is not None and np.isfinite(e) for e in v)]
    fit = np.unique(np.array([v for _, v in x]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:most]
    deviation = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for i, row in x}
    return n, deviation, {i: (row - s / n) @ v[:, order] / np.sqrt(e[order]) for i, row in x}, e[order] / e.sum()


def check(got, rows):
    n, deviation, white, explained = expected(rows)
    assert len(got) == len(white) * len(explained)
    signs = {}
    for r in got:
        want = white[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert abs(sign * r.whitened - want) < 1e-8 and r.n == n and r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and 0 <= r.identity_error < 1e-8


def test_query_against_dense_solver(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(registry.op11_whitening(spark, "/root/testdata/sf0.001").collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0]), (104, []), (105, [1.0, 2.0])]
    same = [(200, rows[0][1]), (201, rows[0][1])]
    schema = "vec_id long, embedding array<double>, n int, component string"
    table = lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], schema)
    got = whitening.whiten(table(rows + bad + same)).collect()
    check(got, rows + same)
    assert len(whitening.whiten(table(rows + [rows[3], (None, rows[4][1])])).collect()) == 32 * 3
    assert whitening.whiten(table([])).collect() == [] and whitening.whiten(table(bad[:4])).collect() == [] and whitening.whiten(table([(1, [1.0, 2.0])] * 3)).collect() == []
    far = [(i, [1e12 * (i % 7), float(i), -float(i * i)]) for i in range(20)]
    assert {r.deviation for r in whitening.whiten(table(far)).collect() if r.vec_id == 3} == {None}
