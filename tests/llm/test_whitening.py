import math

import numpy as np
import pytest

from panelcast.llm import whitening


def covariance(x):
    off = x - x.mean(0)
    return off.T @ off / len(x)


@pytest.mark.parametrize("seed", range(6))
def test_rank_one_updates_equal_a_dense_decomposition(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 5, 16, 33, 64][seed]
    e, q, whole = np.zeros(d), np.eye(d), np.zeros((d, d))
    for k in range(40):
        v = rng.standard_normal(d) * 10.0 ** rng.integers(-6, 4)
        if k % 5 == 0:
            v = np.eye(d)[rng.integers(d)]      # coordinates that are not touched, equal eigenvalues
        if k % 7 == 0:
            v = q[:, -1] * 3                    # along an eigenvector
        e, q = whitening.rank_one(e, q, v)
        whole += np.outer(v, v)
    scale = np.abs(whole).max()
    assert np.abs(q.T @ q - np.eye(d)).max() < 1e-12
    assert np.abs(q @ np.diag(e) @ q.T - whole).max() < 1e-12 * scale
    assert (np.diff(e) >= 0).all()


def test_secular_roots_interlace_and_solve():
    rng = np.random.default_rng(1)
    d = np.sort(rng.standard_normal(40))
    d[10] = d[9] + 1e-11
    w = rng.random(40) * 10.0 ** rng.integers(-12, 3, 40) + 1e-16
    dist, roots = whitening.secular_roots(d, w)
    assert (roots[:-1] >= d[:-1]).all() and (roots[:-1] <= d[1:]).all() and roots[-1] <= d[-1] + w.sum() * 1.0000001
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w), np.sqrt(w)))
    assert np.abs(roots - want).max() < 1e-12 * np.abs(want).max()


def test_combined_spectra_equal_one_of_all_rows():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((500, 12)) * 40).astype(np.int64) + 10**6
    parts = [x[:3], x[3:200], x[200:200], x[200:]]
    whole = whitening.Spectrum(12)
    for part in parts:
        one = whitening.Spectrum(12)
        if len(part):
            one.add_rows(part)
        whole.add(whitening.Spectrum.unpack(one.pack(), 12))
    assert whole.n == 500 and (whole.sums == x.sum(0)).all()
    assert np.allclose(whole.e, np.linalg.eigvalsh(covariance(x.astype(float))) * 500, rtol=1e-9)


def make(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, component int, _vec double, _id string")


def check(rows, got, dim, count=32):
    valid = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in valid], dtype=object)
    n, sums = len(valid), x.sum(0)
    e, u = np.linalg.eigh(covariance(np.array(x, float)))
    e, u = e[::-1], u[:, ::-1]
    used = min(count, int((e > 1e-12 * e[0]).sum()))
    assert len(got) == n * used
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    white = ((np.array(x, float) - np.array(sums, float) / n) @ u / np.sqrt(np.maximum(e, 1e-300)))[:, :used]
    found = np.zeros_like(white)
    for k, (i, _) in enumerate(valid):
        for c in range(used):
            r = by[i][c + 1].pop(0)
            found[k, c] = r.whitened
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x[k], sums, strict=True))
            assert abs(r.explained - e[c] / e.sum()) <= 1e-9
            assert r.identity_error <= 1e-8
    signs = np.sign((found * white).sum(0))
    assert np.abs(found * signs - white).max() < 1e-5


def vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    scales = np.linspace(2, 0.2, dim)
    return [(k, [float(c) for c in rng.standard_normal(dim) * scales]) for k in range(n)]


def test_whitening_equals_a_dense_decomposition(spark):
    rows = vectors(700, 40) + [(900, None), (901, [float("nan")] * 40), (902, [None] * 40), (903, []), (904, [1.0] * 3),
                               (905, [float("inf")] + [0.0] * 39), (906, [0.0] * 40)]
    got = whitening.whiten(make(spark, rows).repartition(11)).collect()
    check(rows, got, 40)


def test_few_dimensions_and_constant_ones(spark):
    rows = [(k, [*v, 0.5]) for k, v in vectors(60, 5, 2)]
    got = whitening.whiten(make(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5}  # the constant dimension gives none
    check(rows, got, 6)


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(50, 4, 3)
    got = whitening.whiten(make(spark, rows + rows[:10] + [(None, rows[0][1])] * 2)).collect()
    assert len(got) == 62 * 4 and sum(r.vec_id is None for r in got) == 8 and {r.n for r in got} == {62}


def test_nothing_to_whiten(spark):
    assert whitening.whiten(make(spark, [])).collect() == []
    assert whitening.whiten(make(spark, [(1, None), (2, [float("nan")])])).collect() == []
    assert whitening.whiten(make(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    with pytest.raises(Exception, match="grid"):
        whitening.whiten(make(spark, [(1, [1e30, 2.0]), (2, [1.0, 2.0])])).collect()
