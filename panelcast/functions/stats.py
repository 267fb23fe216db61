"""Distribution tail functions for small result tables (no scipy needed).

`with_f_tail` works in column expressions; the plain functions are its check and serve k-row coefficient tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % normal quantile used for confidence intervals.
Z_975 = 1.959963984540054


def norm_sf2(z: float) -> float:
    """Two-sided normal tail probability P(|Z| > |z|)."""
    if z is None or math.isnan(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


def _betacf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 1e-15) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x > 0 as a column expression: Stirling's series from x + 10 on."""
    z = x + 10
    shift = F.log(x)
    for k in range(1, 10):
        shift = shift + F.log(x + k)
    i = 1 / z
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def with_f_tail(df: DataFrame, f: str, d1: Column, d2: Column, out: str = "p_value", steps: int = 600) -> DataFrame:
    """Adds P(F(d1, d2) > f): the incomplete beta function by its continued fraction, in column expressions.

    The fraction is iterated (modified Lentz) inside an aggregate over the step numbers, and stands
    still once it has settled. NaN without degrees of freedom.
    """
    f1, f2, v = F.col("_d1"), F.col("_d2"), F.col(f"`{f}`")
    d = df.withColumns({"_d1": d1.cast("double"), "_d2": d2.cast("double")})
    d = d.withColumns({"_lo": f2 / (f2 + f1 * v), "_hi": f1 * v / (f2 + f1 * v)})
    d = d.withColumn("_swap", F.col("_lo") >= (f2 / 2 + 1) / (f1 / 2 + f2 / 2 + 2))
    swap = F.col("_swap")
    d = d.withColumns({"_a": F.when(swap, f1 / 2).otherwise(f2 / 2), "_b": F.when(swap, f2 / 2).otherwise(f1 / 2),
                       "_x": F.when(swap, F.col("_hi")).otherwise(F.col("_lo"))})
    a, b, x = F.col("_a"), F.col("_b"), F.col("_x")
    tiny = 1e-300

    def safe(value):
        return F.when(F.abs(value) < tiny, F.lit(tiny)).otherwise(value)

    def both(state, i):
        # odd steps 2m + 1 and even steps 2m of the fraction
        m = F.floor(i / 2).cast("double")
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        term = F.when(i % 2 == 1, odd).otherwise(even)
        return F.when(state["still"], state).otherwise(step(1 / safe(1 + term * state["d"]), safe(1 + term / state["c"]), state["h"]))

    def step(d_, c_, h):
        return F.struct(c_.alias("c"), d_.alias("d"), (h * d_ * c_).alias("h"), (F.abs(d_ * c_ - 1) < 1e-16).alias("still"))
    d = d.withColumn("_first", 1 / safe(1 - (a + b) * x / (a + 1)))
    first = F.struct(F.lit(1.0).alias("c"), F.col("_first").alias("d"), F.col("_first").alias("h"), F.lit(False).alias("still"))
    d = d.withColumns({"_value": F.aggregate(F.sequence(F.lit(2), F.lit(steps)), first, both, lambda s: s["h"]),
                       "_gab": log_gamma(a + b), "_ga": log_gamma(a), "_gb": log_gamma(b)})
    front = F.exp(F.col("_gab") - F.col("_ga") - F.col("_gb") + a * F.log(x) + b * F.log1p(-x)) / a
    tail = F.when(swap, 1 - front * F.col("_value")).otherwise(front * F.col("_value"))
    value = (F.when(v.isNull() | F.isnan(v) | (f1 <= 0) | (f2 <= 0), F.lit(float("nan"))).when(v == float("inf"), F.lit(0.0))
             .when(v <= 0, F.lit(1.0)).otherwise(tail))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], value.alias(out))


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail P(F(d1, d2) > f)."""
    if f is None or d1 is None or d2 is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
