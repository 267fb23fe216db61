import math

import pytest

from panelcast.functions.stats import f_sf, norm_sf2
from panelcast.operators import search as SE
from panelcast.plans import studies as ST

# Golden (F, k, n, p) pairs from recorded significance reports.
F_GOLDEN = [
    (367.528122, 2, 40, 3.916792e-21),
    (2.985216, 3, 34, 6.521703e-02),
    (0.276778, 2, 24, 6.040846e-01),
    (0.348252, 3, 32, 7.088326e-01),
    (0.087267, 2, 11, 7.743821e-01),
    (10.611851, 4, 40, 3.8e-05),  # recorded with 6 decimals only
    (34.124752, 3, 40, 3.987134e-09),
]


@pytest.mark.parametrize("f,k,n,p", F_GOLDEN)
def test_f_pvalue_goldens(f, k, n, p):
    got = f_sf(f, k - 1, n - k)
    if p == 3.8e-05:
        assert round(got, 6) == p
    else:
        assert got == pytest.approx(p, rel=2e-3)


def test_norm_tail():
    assert norm_sf2(1.959963984540054) == pytest.approx(0.05, rel=1e-9)
    assert math.isnan(f_sf(float("nan"), 1, 2))


def test_logistic_grid_sizes():
    g = SE.grid(ST.LOGISTIC_SPACE)
    assert len(g) == 2600
    assert len(SE.dedupe_logistic(g)) == 520


def test_space_typing():
    t = SE.typed_space(ST.RF_SPACE[0])
    assert isinstance(t["n_estimators"], SE.Choice)
    assert isinstance(t["min_samples_split"], SE.IntRange)
    assert isinstance(t["ccp_alpha"], SE.RealRange)
    assert isinstance(t["max_samples"], SE.Choice)
    assert isinstance(SE.typed_dim((0.5, 1.0)), SE.RealRange)


def test_random_trials_seeded_and_conditional():
    a = SE.random_trials(ST.RF_SIGNIFICANCE_SPACE, 40, seed=1337)
    b = SE.random_trials(ST.RF_SIGNIFICANCE_SPACE, 40, seed=1337)
    assert a == b and len(a) == 40
    c = SE.rf_conditional(a)
    assert all(t["max_samples"] is None for t in c if not t["bootstrap"])


def surface(trials):
    """A smooth hill over a real, a log and an integer range, and a choice that shifts it."""
    return [-(t["a"] - 0.7) ** 2 - (math.log10(t["b"]) + 2) ** 2 / 4 - ((t["c"] - 13) / 20) ** 2 + 0.2 * (t["d"] == "y") for t in trials]


SURFACE = {"a": (0.0, 1.0), "b": (1e-4, 1.0, "log-uniform"), "c": (1, 40), "d": ["x", "y", "z"]}


def test_sequential_search_beats_random_draws():
    better = 0
    for seed in range(8):
        trials, scores = SE.sequential_trials(SURFACE, surface, 48, seed=seed)
        assert len(trials) == len(scores) == 48 and scores == pytest.approx(surface(trials))
        better += max(scores) > max(surface(SE.random_trials(SURFACE, 48, seed + 1000)))
    assert better >= 7
    assert SE.sequential_trials(SURFACE, surface, 30, seed=3) == SE.sequential_trials(SURFACE, surface, 30, seed=3)


def test_sequential_search_of_a_small_space_stops_at_its_points():
    space = {"k": [1, 2, 3], "m": ["a", "b"]}
    trials, _ = SE.sequential_trials(space, lambda ts: [t["k"] for t in ts], 6, batch=2, start=2)
    assert len(trials) == 6


def test_f_tail_columns_equal_the_plain_functions(spark):
    from pyspark.sql import functions as F

    from panelcast.functions.stats import log_gamma, with_f_tail
    cases = [(f, d1, d2) for f, k, n, _ in F_GOLDEN for d1, d2 in ((k - 1, n - k),)]
    cases += [(f, d1, d2) for f in (0.01, 0.5, 1.0, 1.3, 4.0, 90.0) for d1 in (1, 2, 7, 300) for d2 in (1, 3, 40, 60_000)]
    df = spark.createDataFrame([(float(f), d1, d2) for f, d1, d2 in cases], "f double, d1 int, d2 int")
    for r in with_f_tail(df, "f", F.col("d1"), F.col("d2"), "p").collect():
        assert r.p == pytest.approx(f_sf(r.f, r.d1, r.d2), rel=1e-9, abs=1e-300)
    odd = spark.createDataFrame([(float("nan"), 1, 2), (float("inf"), 1, 2), (0.0, 1, 2), (1.0, 0, 2), (None, 1, 2)], "f double, d1 int, d2 int")
    assert [str(r.p) for r in with_f_tail(odd, "f", F.col("d1"), F.col("d2"), "p").collect()] == ["nan", "0.0", "1.0", "nan", "nan"]
    for r in spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in (0.5, 1.0, 2.5, 10.0, 3e4)])).alias("x")).select(
            "x", log_gamma(F.col("x")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-11)
