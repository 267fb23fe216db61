"""Categorical encoding (P13, P14) and class weights (M8)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A one-hot column per level only makes sense for a bounded domain.
MAX_LEVELS = 10_000


def levels(df: DataFrame, col: str, max_levels: int = MAX_LEVELS) -> list:
    """A4: sorted distinct non-null levels (native order: numbers numerically).

    Only the distinct values reach the driver, and their number is checked
    before they are fetched.
    """
    d = df.select(col).where(F.col(col).isNotNull()).distinct()
    top = d.orderBy(col).limit(max_levels + 1).collect()
    if len(top) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels; not a one-hot column")
    return [r[0] for r in top]


def dummy_name(prefix: str, level) -> str:
    """prefix_level without characters that column references treat specially."""
    if isinstance(level, float) and level.is_integer():
        level = int(level)
    return f"{prefix}_{re.sub(r'[^0-9A-Za-z_#-]', '_', str(level))}"


def one_hot(df: DataFrame, col: str, lvls=None, drop_first: bool = True,
            prefix: str | None = None, keep_source: bool = False,
            max_levels: int = MAX_LEVELS) -> tuple[DataFrame, list[str]]:
    """``get_dummies(columns=[col], drop_first=...)`` as 0/1 int columns.

    The first (smallest) level is the baseline when ``drop_first``.
    Returns the frame and the new column names in level order.
    """
    lvls = list(lvls) if lvls is not None else levels(df, col, max_levels)
    prefix = prefix or col
    kept = lvls[1:] if drop_first else lvls
    names = [dummy_name(prefix, v) for v in kept]
    cols = [(F.col(col) == F.lit(v)).cast("int").alias(n) for v, n in zip(kept, names)]
    out = df.select("*", *cols)
    if not keep_source:
        out = out.drop(col)
    return out, names


def fold_dummies(df: DataFrame, col: str, period: str, folds: DataFrame, drop_first: bool = True,
                 prefix: str | None = None) -> DataFrame:
    """P14/U2 for all expanding folds at once: (horizon, train_end, split, level, dummy, baseline, ones).

    In each fold the splits train (period <= train_end), val and test are encoded apart, each
    without its own first level, and then share the union of their columns; a column that a
    split lacks is 0 there. `baseline` tells that the level is the split's own first one, whose rows are
    0 in its column too; `ones` counts a split's rows with a 1. Everything follows from one aggregate:
    which levels a period has. Its size is bounded by periods x levels; no loop runs over the folds.
    """
    prefix = prefix or col
    seen = df.filter(F.col(col).isNotNull()).groupBy(F.col(period).alias("_p"), F.col(col).alias("level")).agg(
        F.count(F.lit(1)).alias("_n"))
    split = (F.when(F.col("_p") <= F.col("train_end"), F.lit("train")).when(F.col("_p") == F.col("val_period"), F.lit("val"))
             .when(F.col("_p") == F.col("test_period"), F.lit("test")))
    fold = ["horizon", "train_end"]
    has = (folds.join(seen, (F.col("_p") <= F.col("train_end")) | (F.col("_p") == F.col("val_period"))
                      | (F.col("_p") == F.col("test_period")))
           .groupBy(*fold, split.alias("split"), "level").agg(F.sum("_n").alias("_n")))
    first = has.groupBy(*fold, "split").agg(F.min("level").alias("_first"))
    has = has.join(first, [*fold, "split"])
    dropped = (F.col("level") == F.col("_first")) if drop_first else F.lit(False)
    has = has.withColumn("baseline", dropped)
    columns = has.filter(~F.col("baseline")).select(*fold, "level").distinct()
    grid = columns.join(first.select(*fold, "split"), fold)
    out = grid.join(has.select(*fold, "split", "level", "baseline", "_n"), [*fold, "split", "level"], "left")
    absent = F.coalesce("baseline", F.lit(False))
    return out.select(*fold, "split", "level", F.concat(F.lit(f"{prefix}_"), F.col("level").cast("string")).alias("dummy"),
                      absent.alias("baseline"), F.when(absent, 0).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("ones"))


def class_weight_column(df: DataFrame, label: str, scheme, out: str = "w") -> DataFrame:
    """M8: per-row weight for a class-weight scheme.

    None -> 1; 'balanced' -> n / (2 * n_c) from a per-class aggregate;
    {0: a, 1: b} -> the class's weight, 1 where it has none; a number w -> {1: w}.
    """
    if scheme is None:
        return df.withColumn(out, F.lit(1.0))
    if scheme == "balanced":
        w = class_weight_table(df, label, (scheme,)).select(label, F.col("weight").alias(out))
        # One row per class: the broadcast side is bounded by the label domain.
        return df.join(F.broadcast(w), label)
    if isinstance(scheme, tuple):
        scheme = dict(scheme)
    if not isinstance(scheme, dict):
        scheme = {1: scheme}
    weight = F.lit(1.0)
    for level, v in scheme.items():
        weight = F.when(F.col(label) == level, F.lit(float(v))).otherwise(weight)
    return df.withColumn(out, weight)


def class_weight_table(df: DataFrame, label: str, schemes) -> DataFrame:
    """(scheme, label, weight, n, total_weight) of every scheme from one aggregate per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    counts = counts.withColumn("_all", F.sum("n").over(every)).withColumn("_k", F.count(F.lit(1)).over(every))
    rows = []
    for s in schemes:
        if s is None:
            name, weight = "none", F.lit(1.0)
        elif s == "balanced":
            name, weight = s, F.col("_all") / (F.col("_k") * F.col("n"))
        else:
            name, weight = str(s), F.when(F.col(label) == 1, F.lit(float(s))).otherwise(F.lit(1.0))
        rows.append(F.struct(F.lit(name).alias("scheme"), weight.alias("weight")))
    return (counts.select(label, "n", F.inline(F.array(*rows)))
            .select("scheme", label, "weight", "n", (F.col("weight") * F.col("n")).alias("total_weight")))
