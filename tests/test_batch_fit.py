"""Many fits at once: optimality of every problem, equal to dense solutions."""

import numpy as np
import pytest

from panelcast.operators import batch_fit as BF
from panelcast.operators import metrics as M
from panelcast.operators import models as MD
from panelcast.operators import search as SE

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 3, 600), rng.integers(0, 2, 600), rng.integers(-2, 3, 600) / 2]).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(1.5 - 0.8 * x[:, 0] + x[:, 1] - 0.5 * x[:, 2]))).astype(int)
    fold = rng.integers(0, 4, 600)
    df = spark.createDataFrame([(*map(float, r), int(t), int(f)) for r, t, f in zip(x, y, fold, strict=True)],
                               "a double, b double, c double, y int, fold int").repartition(5).cache()
    return df, x, y, fold


def residual(x, y, w, beta, c, l1, intercept, penal):
    """Optimality residual of sum(w loss) / sum(w) + penalty / (c sum(w)), written out row by row."""
    z = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-z @ beta))
    g = z.T @ (w * (p - y)) / w.sum()
    lam = 0 if c is None else 1 / (c * w.sum())
    out = []
    for j in range(len(beta)):
        if j == 0 and not intercept:
            assert beta[0] == 0
            continue
        pen = lam if j or penal else 0
        s = g[j] + pen * (1 - l1) * beta[j]
        out.append(abs(s + pen * l1 * np.sign(beta[j])) if beta[j] else max(abs(s) - pen * l1, 0))
    return max(out)


def test_every_problem_is_optimal(data):
    df, x, y, fold = data
    cases = [dict(c=c, l1=l1, weights=w, fit_intercept=i, penal_intercept=pi and i)
             for c, l1 in ((None, 0.0), (0.01, 0.0), (1.0, 0.0), (0.02, 1.0), (1.0, 1.0), (0.05, 0.5))
             for w in (None, "balanced", (1.0, 4.0)) for i in (True, False) for pi in (False, True)]
    problems = [BF.Problem(train=frozenset("0123") - {str(k)}, test=frozenset({str(k)}), **case) for case in cases for k in range(4)]
    for group in (False, True):
        fits = BF.solve(BF.cells(df, FEATURES, "y", "fold", group=group), FEATURES, problems)
        assert fits.converged.all() and (fits.residual <= 1e-10).all() and fits.passes < 40
        for q, beta in zip(fits.problems, fits.beta, strict=True):
            use = np.array([str(f) in q.train for f in fold])
            t = y[use]
            w = {None: np.ones(use.sum()), "balanced": len(t) / 2 / np.where(t == 1, t.sum(), (1 - t).sum()),
                 (1.0, 4.0): np.where(t == 1, 4.0, 1.0)}[q.weights]
            assert residual(x[use], t, w, beta, q.c, q.l1, q.fit_intercept, q.penal_intercept) < 2e-10
    assert (fits.beta[:, 1:] == 0).any()  # the lasso sets coefficients to nought


def test_a_scaler_is_part_of_the_problem(data):
    df, x, _, _ = data
    centre, scale = x.mean(0), x.std(0)
    scaled = df.selectExpr(*[f"({f} - {m}) / {s} AS {f}" for f, m, s in zip(FEATURES, centre, scale, strict=True)], "y", "fold")
    raw = BF.solve(BF.cells(df, FEATURES, "y"), FEATURES, [BF.Problem(c=0.1, centre=tuple(centre), scale=tuple(scale))])
    own = BF.solve(BF.cells(scaled, FEATURES, "y"), FEATURES, [BF.Problem(c=0.1)])
    assert np.allclose(raw.beta[0, 1:] * scale, own.beta[0, 1:], atol=1e-8)
    assert np.isclose(raw.beta[0, 0] + raw.beta[0, 1:] @ centre, own.beta[0, 0], atol=1e-8)


def test_more_problems_than_a_block(data):
    df, *_ = data
    problems = [BF.Problem(c=0.01 * (k + 1)) for k in range(150)]
    fits = BF.solve(BF.cells(df, FEATURES, "y", group=True), FEATURES, problems)
    assert fits.converged.all()
    size = np.abs(fits.beta[:, 1:]).sum(1)
    assert (np.diff(size) > 0).all()  # a weaker penalty, larger coefficients


def test_probit_tail_values():
    t = np.array([-50.0, -31.0, -30.0, -29.9, -5.0, 0.0, 5.0])
    loss, ratio = BF.log_normal_tail(t)
    assert loss[-2] == pytest.approx(np.log(2)) and ratio[-2] == pytest.approx(np.sqrt(2 / np.pi))
    assert (np.diff(loss) < 0).all() and (np.diff(ratio) < 0).all()
    assert loss[1] == pytest.approx(loss[2] + 30.5, rel=2e-3)


def test_trial_scores_equal_single_fits(data):
    df, *_ = data
    specs = [MD.ModelSpec.of("logistic", C=0.1, penalty="l2"), MD.ModelSpec.of("logistic", C=0.1, penalty="l1", class_weight="balanced"),
             MD.ModelSpec.of("logistic", C=0.1, penalty="l2", solver="liblinear"), MD.ModelSpec.of("logistic", penalty=None)]
    folds = [({"0", "1", "2"}, {"3"}), ({"1", "2", "3"}, {"0"})]
    got = {(r.trial, r.fold): r for r in SE.logistic_ap(specs, df, "fold", folds, FEATURES, details=True, digits=9).collect()}
    assert len(got) == 8 and all(r.converged and r.residual <= 1e-10 for r in got.values())
    for i, s in enumerate(specs):
        f = MD.fit(s, df.filter("fold <> 3"), FEATURES)
        scored = MD.score(f, df.filter("fold = 3"), ["y"]).selectExpr("y", "round(score, 9) AS score")
        assert got[i, 0].ap == pytest.approx(M.average_precision(scored, []).first().ap, abs=1e-9)


def test_a_fit_without_rows_or_folds_does_not_hang(spark):
    df = spark.createDataFrame([], "a double, y int")
    fits = BF.solve(BF.cells(df, ["a"], "y"), ["a"], [BF.Problem(c=1.0)])
    assert fits.passes == 0 and not fits.converged[0]


def test_null_features_fail(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 0)], "a double, y int")
    with pytest.raises(Exception, match="null in the column a"):
        BF.solve(BF.cells(df, ["a"], "y"), ["a"], [BF.Problem(c=1.0)])
