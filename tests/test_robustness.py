"""Faults that once were silent: null scores, name matching, degenerate statistics, what MLlib cannot honour."""

import math

import pytest
from pyspark.sql import functions as F

from panelcast.operators import metrics as M
from panelcast.operators import models as MD
from panelcast.operators import search as SE
from panelcast.operators.anova import oneway_anova
from panelcast.operators.encode import class_weight_column
from panelcast.operators.inference import coefficient_table
from panelcast.plans.studies import RF_SPACE, STUDIES
from panelcast.session import spread
from panelcast.sources import readers as R


def test_null_scores_fail(spark):
    df = spark.createDataFrame([(1, 0.5), (0, None)], "y int, score double")
    for metric in (M.average_precision, M.pr_curve):
        with pytest.raises(Exception, match="null in the score column"):
            metric(df, []).collect()


def test_csv_columns_by_name(spark, tmp_path):
    c = tmp_path / "m.csv"
    c.write_text("policy,adopt,x,extra\na,1,0.5,z\nb,0,,z\n")
    df = R.read_csv(spark, str(c), "adopt int, x double, policy string")
    assert sorted(map(tuple, df.collect()), key=str) == [(0, None, "b"), (1, 0.5, "a")]
    with pytest.raises(ValueError, match="year"):
        R.read_csv(spark, str(c), "adopt int, year int")


def test_study_keeps_its_columns_and_drops_null_rows(spark, tmp_path):
    study = STUDIES["mallinson"]
    names = [study.label, *study.covariates, *filter(None, (study.unit, study.period, study.item)), "other"]
    names = list(dict.fromkeys(names))[::-1]
    folder = (tmp_path / study.path).parent
    folder.mkdir(parents=True)
    (tmp_path / study.path).write_text("\n".join(",".join(r) for r in (names, ["1"] * len(names), ["2"] * (len(names) - 1) + [""])) + "\n")
    schema = ", ".join(f"`{n}` double" for n in names)
    df = R.load_study(spark, study, str(tmp_path), schema)
    assert "other" not in df.columns and set(study.covariates) <= set(df.columns)
    assert df.count() == 1


def test_anova_without_degrees_of_freedom(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 2.0)], "one string, two string, m double")
    got = {r.param: (r.k, r.n, r.f_stat, r.p_value) for r in oneway_anova(df, ["one", "two"], "m").collect()}
    assert got["one"][:2] == (3, 3) and math.isnan(got["one"][2]) and math.isnan(got["one"][3])
    assert got["two"][2] == pytest.approx(1 / 3) and 0 < got["two"][3] < 1
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "one string, m double")
    assert oneway_anova(flat, ["one"], "m", with_p=False).first().f_stat == math.inf


def test_trials_of_a_union_and_log_uniform_ranges():
    assert len(SE.random_trials(RF_SPACE, 5)) == 5 * len(RF_SPACE)
    draws = [t["a"] for t in SE.random_trials({"a": (1e-4, 1.0, "log-uniform")}, 400)]
    assert 0.4 < sum(d < 1e-2 for d in draws) / 400 < 0.6 and min(draws) >= 1e-4 and max(draws) <= 1
    with pytest.raises(ValueError):
        SE.random_trials({"a": (1, 2, "normal")}, 1)


def test_unsupported_parameters_are_named_and_left_out(spark):
    spec = MD.ModelSpec.of("rf", n_estimators=5, max_depth=50)
    assert spec.unsupported() == ["max_depth"]
    assert spec.effective().p() == {"n_estimators": 5, "max_depth": 30}
    own = MD.ModelSpec.of("rf", n_estimators=5, ccp_alpha=0.1, criterion="entropy", max_depth=50)
    assert own.unsupported() == [] and own.effective() == own
    gbt = MD.ModelSpec.of("gbt", n_estimators=5, tree_method="exact", eval_metric="auc", booster="dart")
    assert gbt.unsupported() == ["eval_metric", "tree_method"] and gbt.effective().p() == {"n_estimators": 5}
    assert MD.ModelSpec.of("logistic", C=1.0, solver="saga").effective() == MD.ModelSpec.of("logistic", C=1.0)
    assert MD.ModelSpec.of("logistic", C=1.0, solver="liblinear").effective() != MD.ModelSpec.of("logistic", C=1.0)
    tf = SE.trials_frame(spark, [{"a": 1}, {"a": 2}], [0.1, 0.2], [["x"], []])
    assert [(r.trial, r.a, r.unsupported) for r in tf.orderBy("trial").collect()] == [(0, "1", "x"), (1, "2", "")]


def test_one_forest_whatever_the_input_partitions(spark):
    rows = [(k, float(k % 17), float(k * 7 % 23), int(k * 13 % 29 < 3)) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    spec = MD.ModelSpec.of("rf", n_estimators=4, max_depth=6)
    found = []
    for n in (1, 3, 8):
        d = spread(df.repartition(n), 4)
        f = MD.fit(spec, d, ["a", "b"])
        found.append(sorted((r.id, r.score) for r in MD.score(f, d, ["id"]).collect()))
        d.unpersist()
    assert found[0] == found[1] == found[2]


def test_a_tree_scores_the_mean_of_each_cell(spark):
    rows = [(float(k % 3 == 0), float(k % 3 == 1), int(k % 3 == 0 and k % 30 == 0 or k % 3 == 1 and k % 50 == 1)) for k in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    spec = MD.ModelSpec.of("rf", n_estimators=1, max_features=None, bootstrap=False)
    for grouped in (False, True):
        f = MD.fit(spec, df, ["a", "b"], group_rows=grouped)
        got = {(r.a, r.b): r.score for r in MD.score(f, df.select("a", "b").distinct(), ["a", "b"]).collect()}
        for cell, want in {(r.a, r.b): r.m for r in df.groupBy("a", "b").agg(F.avg("y").alias("m")).collect()}.items():
            assert got[cell] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        MD.fit(MD.rf_default(), df, ["a", "b"], group_rows=True)


def test_both_class_weights_count(spark):
    df = spark.createDataFrame([(0,), (1,)], "y int")
    got = {r.y: r.w for r in class_weight_column(df, "y", {0: 2.5, 1: 7}).collect()}
    assert got == {0: 2.5, 1: 7.0}


def test_constant_and_collinear_columns_are_reported(spark):
    rows = [(float(k % 5), float(2 * (k % 5) + 1), 3.0, float(k * 7 % 11), int(k * 31 % 13 < 4)) for k in range(260)]
    df = spark.createDataFrame(rows, "a double, twin double, flat double, b double, y int")
    t = {r.term: r for r in coefficient_table(df, "y", ["a", "twin", "flat", "b"]).collect()}
    assert t["twin"].coef is None and t["flat"].coef is None
    clean = {r.term: r for r in coefficient_table(df, "y", ["a", "b"]).collect()}
    for term in ("const", "a", "b"):
        assert t[term].coef == pytest.approx(clean[term].coef, abs=1e-8)
        assert t[term].std_err == pytest.approx(clean[term].std_err, abs=1e-8)


def test_probit_errors_come_from_the_observed_information(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    y = (0.3 + 0.8 * x + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y int")
    t = {r.term: r for r in coefficient_table(df, "y", ["x"], link="probit").collect()}
    beta = np.array([t["const"].coef, t["x"].coef])

    def loss(b):
        eta = (2 * y - 1) * (b[0] + b[1] * x)
        return -np.sum(np.log([0.5 * math.erfc(-e / math.sqrt(2)) for e in eta]))
    h, step = np.zeros((2, 2)), 1e-4
    for i in range(2):
        for j in range(2):
            e, f = np.eye(2)[i] * step, np.eye(2)[j] * step
            h[i, j] = (loss(beta + e + f) - loss(beta + e - f) - loss(beta - e + f) + loss(beta - e - f)) / (4 * step**2)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    assert t["const"].std_err == pytest.approx(se[0], rel=1e-4) and t["x"].std_err == pytest.approx(se[1], rel=1e-4)
