"""Classification metrics as aggregate plans.

Scores arrive as a long DataFrame: one row per scored row with the group
keys (model, fold, ...), the 0/1 label and the positive-class score.
Everything is computed by grouping -- no per-row Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ordered import desc_running_sums


def predict_class(df: DataFrame, score: str = "score", threshold: float = 0.5,
                  out: str = "pred") -> DataFrame:
    """Class decision from a probability (positive when score > threshold)."""
    return df.withColumn(out, (F.col(score) > F.lit(threshold)).cast("int"))


def confusion(df: DataFrame, keys: list[str] | None = None, label: str = "y",
              pred: str = "pred") -> DataFrame:
    """tp, fp, fn, tn per group as one aggregate."""
    keys = keys or []
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*keys).agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
    )


def _safe_div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1_balanced_accuracy(conf: DataFrame) -> DataFrame:
    """E1 (binary F1 of the positive class, 0 when undefined) and E2 (mean class recall)."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    recall1 = _safe_div(tp, tp + fn)
    recall0 = _safe_div(tn, tn + fp)
    return conf.withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)) \
               .withColumn("balanced_accuracy", (recall1 + recall0) / 2)


def class_report(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Precision / recall / f1 / support per class, accuracy, macro and weighted avg.

    Long format: (keys..., row, precision, recall, f1, support); ``row`` is
    '0', '1', 'accuracy', 'macro avg', 'weighted avg'.
    """
    keys = keys or []
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn

    def cls(label, t, f_pos, f_neg):
        prec = _safe_div(t, t + f_pos)
        rec = _safe_div(t, t + f_neg)
        f1 = _safe_div(2 * prec * rec, prec + rec)
        return F.struct(F.lit(label).alias("row"), prec.alias("precision"),
                        rec.alias("recall"), f1.alias("f1"), (t + f_neg).alias("support"))

    c0 = cls("0", tn, fn, fp)
    c1 = cls("1", tp, fp, fn)
    base = conf.select(*keys, c0.alias("c0"), c1.alias("c1"), n.alias("n"),
                       _safe_div(tp + tn, n).alias("acc"))

    def avg_row(name, w0, w1):
        return F.struct(
            F.lit(name).alias("row"),
            (F.col("c0.precision") * w0 + F.col("c1.precision") * w1).alias("precision"),
            (F.col("c0.recall") * w0 + F.col("c1.recall") * w1).alias("recall"),
            (F.col("c0.f1") * w0 + F.col("c1.f1") * w1).alias("f1"),
            F.col("n").alias("support"))

    acc = F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                   F.col("n").alias("support"))
    w0 = _safe_div(F.col("c0.support"), F.col("n"))
    w1 = _safe_div(F.col("c1.support"), F.col("n"))
    rows = F.array(F.col("c0"), F.col("c1"), acc, avg_row("macro avg", F.lit(0.5), F.lit(0.5)),
                   avg_row("weighted avg", w0, w1))
    return base.select(*keys, F.inline(rows))


_ALL = "_pc_all"


def _with_group(scores: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Ungrouped metrics use one constant group so every join has a key."""
    if keys:
        return scores, keys
    return scores.withColumn(_ALL, F.lit(0)), [_ALL]


def _score_counts(scores: DataFrame, keys: list[str], label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row per (keys, distinct score) with positives and rows at that score.

    With ``weight`` a row stands for that many rows (a long).

    A row without a score fails the query: left out, it would change the metric in silence.
    """
    known = F.when(F.col(score).isNotNull(), F.col(score)).otherwise(
        F.raise_error(F.lit(f"null in the score column {score}")).cast(scores.schema[score].dataType))
    scores = scores.withColumn(score, known)
    if weight:
        return scores.groupBy(*keys, score).agg(
            F.sum(F.col(label).cast("long") * F.col(weight)).alias("tp"), F.sum(weight).alias("n"))
    return scores.groupBy(*keys, score).agg(
        F.sum(F.col(label).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))


def average_precision(scores: DataFrame, keys: list[str], label: str = "y",
                      score: str = "score", n_buckets: int | None = None, weight: str | None = None) -> DataFrame:
    """AP = sum over distinct scores (descending) of (R_k - R_{k-1}) * P_k.

    No interpolation; tied scores form one threshold.  Groups without a
    positive get ap = 0.0 (n_pos = 0 tells them apart).  ``n_buckets`` is the number of
    range partitions of the sort (default: the session's).
    """
    out_keys = list(keys)
    scores, keys = _with_group(scores, keys)
    counts = _score_counts(scores, keys, label, score, weight)
    cum = desc_running_sums(counts, keys, score, ["tp", "n"], n_buckets)
    contrib = cum.withColumn("_c", F.col("tp") * F.col("cum_tp") / F.col("cum_n"))
    out = contrib.groupBy(*keys).agg(
        F.sum("_c").alias("_s"), F.sum("tp").alias("n_pos"), F.sum("n").alias("n"))
    return out.select(*out_keys, _safe_div(F.col("_s"), F.col("n_pos").cast("double")).alias("ap"),
                      "n", "n_pos")


def pr_curve(scores: DataFrame, keys: list[str], label: str = "y", score: str = "score",
             n_buckets: int | None = None) -> DataFrame:
    """E5: (precision, recall, threshold) at every distinct score plus the end point (1, 0)."""
    out_keys = list(keys)
    scores, keys = _with_group(scores, keys)
    counts = _score_counts(scores, keys, label, score)
    cum = desc_running_sums(counts, keys, score, ["tp", "n"], n_buckets)
    tot = counts.groupBy(*keys).agg(F.sum("tp").alias("_pos"))
    pts = cum.join(tot, keys).select(
        *out_keys,
        (F.col("cum_tp") / F.col("cum_n")).alias("precision"),
        F.when(F.col("_pos") > 0, F.col("cum_tp") / F.col("_pos")).otherwise(F.lit(1.0)).alias("recall"),
        F.col(score).cast("double").alias("threshold"))
    end = tot.select(*out_keys, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                     F.lit(None).cast("double").alias("threshold"))
    return pts.unionByName(end)


def summarize(metric: DataFrame, by: list[str], value: str = "ap") -> DataFrame:
    """A5: mean and population std of a metric per group (forecast summary)."""
    return metric.groupBy(*by).agg(
        F.avg(value).alias(f"mean_{value}"),
        F.stddev_pop(value).alias(f"std_{value}"),
        F.count(F.lit(1)).alias("n_folds"))


def pivot_models(metric: DataFrame, fold: str, model: str, models: list[str],
                 value: str = "ap") -> DataFrame:
    """One column per model (the forecast time-series table)."""
    return (metric.groupBy(fold).pivot(model, models).agg(F.first(value))
            .select(fold, *[F.col(m).alias(f"{m}_{value}") for m in models]))
