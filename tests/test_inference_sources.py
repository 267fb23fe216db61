import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators.inference import coefficient_table
from panelcast.sources import readers as R


def test_logit_single_dummy_closed_form(spark):
    # group a: 30 of 100 positive, group b: 10 of 50 positive
    rows = [(0, int(i < 30)) for i in range(100)] + [(1, int(i < 10)) for i in range(50)]
    df = spark.createDataFrame(rows, "d int, y int")
    t = {r.term: r for r in coefficient_table(df, "y", ["d"]).collect()}
    la, lb = math.log(.3 / .7), math.log(.2 / .8)
    assert t["const"].coef == pytest.approx(la, abs=1e-8)
    assert t["d"].coef == pytest.approx(lb - la, abs=1e-8)
    se = math.sqrt(1 / (100 * .3 * .7) + 1 / (50 * .2 * .8))
    assert t["d"].std_err == pytest.approx(se, rel=1e-6)
    assert t["d"].p_value == pytest.approx(math.erfc(abs(t["d"].z) / math.sqrt(2)), rel=1e-9)


def test_whitespace_and_csv_readers(spark, tmp_path):
    p = tmp_path / "berry.txt"
    p.write_text("  1  86 0 2.5\n2 87 1   3.0\n\n")
    df = R.read_whitespace(spark, str(p), [("state", "int"), ("year", "int"), ("adopt", "int"),
                                           ("fiscal_1", "double")])
    assert [tuple(r) for r in df.orderBy("state").collect()] == [(1, 86, 0, 2.5), (2, 87, 1, 3.0)]
    c = tmp_path / "m.csv"
    c.write_text("adopt,policy,x\n1,a,0.5\n0,b,\n")
    d2 = R.read_csv(spark, str(c), "adopt int, policy string, x double")
    assert d2.filter(F.col("x").isNull()).count() == 1


def test_stata_ingest(spark, tmp_path):
    d = tmp_path / "dta"
    d.mkdir()
    pd.DataFrame({"state": [1, 2, 3], "year": [1990, 1991, 1992], "adopt": [0.0, 1.0, 0.0],
                  "extra": ["a", "b", "c"]}).to_stata(d / "panel.dta", write_index=False)
    df = R.read_stata(spark, str(d), "state int, year int, adopt double")
    assert sorted(tuple(r) for r in df.collect()) == [(1, 1990, 0.0), (2, 1991, 1.0), (3, 1992, 0.0)]


def test_load_study_whitespace_with_sentinel(spark, tmp_path):
    from panelcast.plans.studies import STUDIES
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "berry_berry1990.txt").write_text(
        "1 86 0 1.0 1 0 0 2.0 0 0.5 3\n2 86 1 1.0 9 0 0 2.0 0 0.5 3\n")
    df = R.load_study(spark, STUDIES["berry_berry"], str(tmp_path))
    assert df.count() == 1 and df.first().party == 1.0


def test_prune_space_and_inference_table(spark):
    from panelcast.plans.workflows import inference_table, prune_space
    ft = spark.createDataFrame([("a", 0.01), ("b", 0.5)], "param string, p_value double")
    lm = spark.createDataFrame([("a", "3", 1), ("a", "1", 2), ("a", "2", 3), ("b", "x", 1), ("b", "y", 2)],
                               "param string, level string, rank int")
    out = prune_space(ft, lm, {"a": (1, 2, 3), "b": ["x", "y"], "c": [True]})
    assert out == {"a": [3, 1], "b": ["x"], "c": [True]}
    rows = [("s1", 0.0, 0), ("s1", 1.0, 1), ("s2", 0.5, 1), ("s2", 0.2, 0), ("s3", 0.9, 1), ("s3", 0.1, 0),
            ("s1", 0.3, 1), ("s2", 0.7, 0), ("s3", 0.4, 0)]
    df = spark.createDataFrame(rows, "state string, x double, y int")
    t = inference_table(df, "y", ["x"], one_hot=("state",), drop_prefixes=("state_",))
    assert [r.term for r in t.collect()] == ["const", "x"]
