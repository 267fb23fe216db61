"""Average precision from packed scores equals the grouped aggregates and sums written out row by row."""

import numpy as np
import pytest

from panelcast.operators import batch_fit as BF
from panelcast.operators import metrics as M
from panelcast.operators import packed

FEATURES = ["a", "b"]


def by_hand(y, score, w):
    out, n, pos = 0.0, 0, 0
    for v in sorted(set(score.tolist()), reverse=True):
        at = score == v
        n, pos = n + w[at].sum(), pos + (w * y)[at].sum()
        out += (w * y)[at].sum() * pos / n
    return out / pos if pos else 0.0


@pytest.mark.parametrize("weighted", [False, True])
def test_packed_precision_equals_the_sum_over_thresholds(spark, monkeypatch, weighted):
    monkeypatch.setattr(packed, "RANGE", 60)  # many ranges a problem, and tasks that send their scores in parts
    monkeypatch.setattr(packed, "HELD", 200)
    rng = np.random.default_rng(3)
    n = 700
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 3, n)]).round(2)
    y, fold, w = (rng.random(n) < 0.2).astype(int), rng.integers(0, 4, n), rng.integers(1, 4, n) if weighted else np.ones(n, int)
    y[fold == 3] = 0
    df = spark.createDataFrame([(*map(float, r), int(a), int(b), int(c)) for r, a, b, c in zip(x, y, fold, w, strict=True)],
                               "a double, b double, y int, fold int, w int").repartition(3)
    rows = BF.kept(BF.cells(df, FEATURES, "y", "fold", weight="w"))
    # one model ranks all rows, one has three scores, one scores every row alike; fold 3 has no positive, fold 9 no row
    beta = np.array([[0.1, 1.5, -0.7], [0.0, 0.0, 0.4], [0.3, 0.0, 0.0]])
    tests = [frozenset("0"), frozenset("12"), frozenset("3"), frozenset("9")]
    problems = [BF.Problem(test=t) for _ in beta for t in tests]
    fits = BF.Fits(FEATURES, problems, ["0", "1", "2", "3"], np.repeat(beta, len(tests), 0), np.zeros(12), np.ones(12, bool), 0)
    found = {r["problem"]: r for r in packed.average_precision(rows, BF.scored(rows, fits)).collect()}
    grouped = {r["problem"]: r for r in M.average_precision(BF.scores(rows, fits), ["problem"], "y", weight="weight").collect()}
    assert set(found) == set(grouped) == {k for k in range(12) if k % 4 < 3}
    for k, r in found.items():
        at = np.isin(fold.astype(str), list(problems[k].test))
        b = beta[k // 4]
        score = 1 / (1 + np.exp(-b[0] - b[1] * x[at, 0] - b[2] * x[at, 1]))
        assert r["ap"] == pytest.approx(by_hand(y[at], score.round(12), w[at]), abs=1e-12)
        assert r["ap"] == pytest.approx(grouped[k]["ap"], abs=1e-12)
        assert (r["n"], r["n_pos"]) == (grouped[k]["n"], grouped[k]["n_pos"]) == (w[at].sum(), (w * y)[at].sum())


def test_equal_rows_have_equal_scores_wherever_they_lie(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 2))
    rows = BF.cells(spark.createDataFrame([(*map(float, x[i % 5]), i % 2, 0) for i in range(1003)], "a double, b double, y int, fold int"),
                    FEATURES, "y", "fold").coalesce(1)
    beta = rng.normal(size=(33, 3))
    fits = BF.Fits(FEATURES, [BF.Problem() for _ in beta], ["0"], beta, np.zeros(33), np.ones(33, bool), 0)
    found = BF.scores(rows, fits).groupBy("problem").agg({"score": "approx_count_distinct"}).collect()
    assert [r[1] for r in found] == [5] * 33


def test_large_tables_stay_where_they_lie(spark):
    rows = spark.range(100, numPartitions=16)
    assert BF.dealt(rows, 30_000_000, 99, 24) is rows
    assert BF.dealt(rows, 30_000_000, 99, 400).rdd.getNumPartitions() == 400
    assert BF.dealt(rows, 100, 99, 24).rdd.getNumPartitions() == 1
