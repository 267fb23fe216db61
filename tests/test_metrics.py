import pytest
from pyspark.sql import functions as F

from panelcast.operators import metrics as M

# Golden confusion counts recovered from recorded reports (tp, fp, fn, tn, F1, balanced accuracy).
GOLDEN = [
    (334, 3439, 110, 5009, 0.1584064500829974, 0.6725868268837019),
    (3, 34, 2, 133, 0.14285714285714288, 0.6982035928143713),
    (0, 0, 5, 167, 0.0, 0.5),
    (629, 5067, 339, 11141, 0.18877551020408162, 0.6685849962879264),
    (0, 1, 157, 8336, 0.0, 0.49994002638838914),
    (1, 9, 25, 219, 0.05555555555555555, 0.49949392712550605),
]


def _rows(tp, fp, fn, tn):
    return [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn


@pytest.mark.parametrize("tp,fp,fn,tn,f1,ba", GOLDEN)
def test_f1_balanced_accuracy_goldens(spark, tp, fp, fn, tn, f1, ba):
    df = spark.createDataFrame(_rows(tp, fp, fn, tn), "y int, pred int")
    r = M.f1_balanced_accuracy(M.confusion(df)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (tp, fp, fn, tn)
    assert r.f1 == pytest.approx(f1, abs=1e-12)
    assert r.balanced_accuracy == pytest.approx(ba, abs=1e-12)


def test_class_report_shape(spark):
    df = spark.createDataFrame(_rows(334, 3439, 110, 5009), "y int, pred int")
    rep = {r.row: r for r in M.class_report(M.confusion(df)).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert round(rep["1"].precision, 2) == 0.09 and round(rep["1"].recall, 2) == 0.75
    assert round(rep["0"].precision, 2) == 0.98 and round(rep["0"].recall, 2) == 0.59
    assert rep["accuracy"].support == 8892 and round(rep["accuracy"].f1, 2) == 0.60
    assert rep["1"].support == 444


def test_average_precision_textbook(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "y int, score double")
    assert M.average_precision(df, []).first().ap == pytest.approx(0.8333333333, abs=1e-9)


def test_average_precision_ties_and_zero_positive(spark):
    df = spark.createDataFrame([("a", 1, .5), ("a", 0, .5), ("a", 1, .2), ("b", 0, .3), ("b", 0, .1)],
                               "g string, y int, score double")
    r = {x.g: x for x in M.average_precision(df, ["g"]).collect()}
    # a: threshold .5 -> P=1/2, R=1/2 ; threshold .2 -> P=2/3, R=1 -> AP = .25 + 1/3
    assert r["a"].ap == pytest.approx(0.5 * 0.5 + 0.5 * (2 / 3))
    assert r["b"].ap == 0.0 and r["b"].n_pos == 0


def test_average_precision_invariant_to_monotone_map(spark):
    rows = [(i % 3 == 0 and 1 or 0, (i * 37 % 101) / 101.0) for i in range(300)]
    df = spark.createDataFrame(rows, "y int, score double")
    a = M.average_precision(df, []).first().ap
    b = M.average_precision(df.withColumn("score", F.exp(F.col("score") * 5) - 7), []).first().ap
    assert a == pytest.approx(b, abs=1e-12)


def test_bucketed_prefix_sums_match_single_window(spark):
    """Many buckets vs one bucket must give the same AP."""
    rows = [(int((i * 7919) % 13 == 0), float((i * 104729) % 997)) for i in range(5000)]
    df = spark.createDataFrame(rows, "y int, score double")
    a = M.average_precision(df, [], n_buckets=1).first().ap
    b = M.average_precision(df, [], n_buckets=64).first().ap
    assert a == pytest.approx(b, abs=1e-12)


def test_pr_curve_end_point_and_thresholds(spark):
    df = spark.createDataFrame([(0, .1), (0, .4), (1, .35), (1, .8)], "y int, score double")
    pts = M.pr_curve(df, []).collect()
    assert len(pts) == 5
    end = [p for p in pts if p.threshold is None][0]
    assert (end.precision, end.recall) == (1.0, 0.0)
    lowest = [p for p in pts if p.threshold == 0.1][0]
    assert lowest.recall == 1.0 and lowest.precision == 0.5


def test_summary_population_std(spark):
    df = spark.createDataFrame([("m", 0.1), ("m", 0.3)], "model string, ap double")
    r = M.summarize(df, ["model"]).first()
    assert r.mean_ap == pytest.approx(0.2) and r.std_ap == pytest.approx(0.1)
