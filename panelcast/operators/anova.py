"""Hyper-parameter significance: one-way ANOVA per parameter (H-F, H-L, A7-A9).

Input: a trials-like DataFrame with one column per parameter and a metric.
Each parameter's levels are compared by a one-way F test; null levels are
excluded, and a parameter with fewer than two levels gets F = p = NaN.
All work is grouping: (param, level) partial moments, then per param.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.stats import with_f_tail


def long_levels(df: DataFrame, params, metric: str) -> DataFrame:
    """Unpivot parameters into (param, level, metric), dropping null levels."""
    pairs = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("level"))
                      for p in params])
    return (df.select(F.col(metric).alias("metric"), F.inline(pairs))
              .filter(F.col("level").isNotNull() & F.col("metric").isNotNull()))


def level_stats(df: DataFrame, params, metric: str) -> DataFrame:
    """Per (param, level): n, mean and M2 of the metric."""
    return long_levels(df, params, metric).groupBy("param", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"),
        (F.var_pop("metric") * F.count(F.lit(1))).alias("m2"))


def level_means(df: DataFrame, params, metric: str) -> DataFrame:
    """H-L / A8: mean metric per level, ranked best first within each parameter."""
    st = level_stats(df, params, metric)
    w = Window.partitionBy("param").orderBy(F.col("mean").desc(), F.col("level"))
    return st.select("param", "level", "n", F.col("mean").alias("mean_metric"),
                     F.row_number().over(w).alias("rank"))


def oneway_anova(df: DataFrame, params, metric: str, with_p: bool = True) -> DataFrame:
    """H-F: (param, k, n, f_stat, p_value); p from the F(k-1, n-k) upper tail."""
    st = level_stats(df, params, metric)
    w = Window.partitionBy("param")
    st = st.withColumn("_N", F.sum("n").over(w)) \
           .withColumn("_grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.col("_N"))
    g = st.groupBy("param").agg(
        F.count(F.lit(1)).alias("k"), F.first("_N").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_grand"), 2)).alias("ssb"),
        F.sum("m2").alias("ssw"))
    k, n = F.col("k"), F.col("n")
    between, within = F.col("ssb"), F.col("ssw")
    # one row per level leaves no degree of freedom; without spread inside levels F is infinite
    fstat = (F.when((k < 2) | (n <= k) | ((within <= 0) & (between <= 0)), F.lit(float("nan")))
             .when(within <= 0, F.lit(float("inf")))
             .otherwise((between / (k - 1)) / F.try_divide(within, n - k)))
    out = g.select("param", k.cast("int").alias("k"), n.cast("long").alias("n"),
                   fstat.alias("f_stat"))
    if with_p:
        out = with_f_tail(out, "f_stat", F.col("k") - 1, F.col("n") - F.col("k"))
    return out


def sort_by_p(ftests: DataFrame) -> DataFrame:
    """O2: ascending p-value, NaN last."""
    return ftests.orderBy(F.when(F.isnan("p_value"), None).otherwise(F.col("p_value"))
                          .asc_nulls_last(), "param")
