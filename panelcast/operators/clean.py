"""Projection, missing-data and scalar operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelcast.spec import PanelSpec


def select_columns(df: DataFrame, cols) -> DataFrame:
    """Column subset; fails loudly on a missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"panel lacks columns {missing}")
    return df.select(*cols)


def drop_any_missing(df: DataFrame, cols=None) -> DataFrame:
    """Drop rows with a null (or floating NaN) in any of ``cols``.

    Only the selected columns count, as in the reference: selection comes
    before the drop, so the column list decides which rows survive.
    """
    cols = list(cols or df.columns)
    cond = F.lit(True)
    types = dict(df.dtypes)
    for c in cols:
        ok = F.col(c).isNotNull()
        if types.get(c) in ("double", "float"):
            ok = ok & ~F.isnan(F.col(c))
        cond = cond & ok
    return df.filter(cond)


def drop_sentinel(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows whose ``col`` equals the missing-value sentinel.

    pandas ``df[df[c] != v]`` keeps rows where c is missing; SQL ``<>``
    would drop them, so the test is the null-safe ``NOT (c <=> v)``.
    """
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def clean_panel(df: DataFrame, spec: PanelSpec, sentinel: tuple[str, object] | None = None,
                extra: tuple[str, ...] = ()) -> DataFrame:
    """P1 + P4 + P3 in the reference's order: select, sentinel filter, null drop."""
    cols = list(dict.fromkeys([*spec.columns(), *extra]))
    out = select_columns(df, cols)
    if sentinel is not None:
        out = drop_sentinel(out, *sentinel)
    return drop_any_missing(out, cols)


def period_bounds(df: DataFrame, period: str) -> DataFrame:
    """A1 + P16: one-row (min, max, mid) of the period; mid = min + (max-min)//2."""
    b = df.agg(F.min(period).alias("min_period"), F.max(period).alias("max_period"))
    return b.withColumn("mid_period",
                        (F.col("min_period")
                         + F.floor((F.col("max_period") - F.col("min_period")) / 2)).cast("int"))


def add_elapsed(df: DataFrame, period: str, out: str = "elapsed") -> DataFrame:
    """elapsed = period - global min(period) (not per unit).

    The bound is a one-row aggregate; joining on a constant key keeps the
    plan a broadcast hash join of a single row.
    """
    b = period_bounds(df, period).withColumn("_pc_one", F.lit(1))
    d = df.withColumn("_pc_one", F.lit(1))
    return (d.join(F.broadcast(b), "_pc_one")
            .withColumn(out, (F.col(period) - F.col("min_period")).cast("int"))
            .drop("_pc_one"))


def without_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """P10: keep rows whose ``col`` does not start with ``prefix``."""
    return df.filter(~F.col(col).startswith(prefix))


def interaction(a: str, b: str) -> Column:
    """Product term ``a:b`` of a formula."""
    return (F.col(a) * F.col(b)).alias(f"{a}:{b}")
