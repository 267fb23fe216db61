"""Binary-response inference: logit / probit coefficient tables.

The rows are first summed to weighted cells (equal label, features and cluster: one partial
aggregate in the JVM), so a discrete design is fitted on its few cells and no key of the
design is hot. The fit is one problem of `batch_fit`; its curvature at the solution is the
observed information (for the logit link also the expected one).

  bread  B = (X' W X)^-1      W: the observed information
  meat   M = sum_g s_g s_g'   s_g = per-cluster score sums (groupBy cluster)
  V = B, or G/(G-1) * (n-1)/(n-k) * B M B with clusters

Constant and collinear columns cannot be estimated: the later one of a dependent set is
dropped and reported with null estimates. Only k x k matrices (k = number of terms) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from panelcast.functions.stats import Z_975, norm_sf2
from panelcast.operators import batch_fit as BF
from panelcast.operators.formula import design

TABLE_SCHEMA = StructType([
    StructField("term", StringType()), StructField("coef", DoubleType()),
    StructField("std_err", DoubleType()), StructField("z", DoubleType()),
    StructField("p_value", DoubleType()), StructField("ci_low", DoubleType()),
    StructField("ci_high", DoubleType()), StructField("converged", BooleanType())])

CONST = "const"


@dataclass
class GlmFit:
    table: DataFrame
    terms: list[str]
    rows: DataFrame    # the persisted weighted cells
    scored: DataFrame  # the same with _p (fitted probability) and _u (weighted score factor)
    converged: bool

    def release(self) -> None:
        self.rows.unpersist()


def independent(m: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Indices of the columns that do not depend on earlier ones, from their gram matrix."""
    kept: list[int] = []
    for j in range(len(m)):
        left = m[j, j]
        if kept:
            b = m[np.ix_(kept, [j])]
            left -= float((b.T @ np.linalg.solve(m[np.ix_(kept, kept)], b)).item())
        if m[j, j] > 0 and left > tol * m[j, j]:
            kept.append(j)
    return kept


def product_sums(rows: DataFrame, cols: list[str]) -> np.ndarray:
    """sum of s s' over the rows, for the columns s: products exploded and summed by cell in the JVM."""
    k = len(cols)
    every = rows.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("_s"))
    one = every.select(F.posexplode("_s").alias("i", "_a"), "_s").filter("_a <> 0")
    two = one.select("i", F.posexplode(F.transform("_s", lambda x: x * F.col("_a"))).alias("j", "v"))
    out = np.zeros((k, k))
    for r in two.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _scored(beta: np.ndarray, width: int, link: str):
    def run(batches):
        for batch in batches:
            x, y, w = BF._matrix(batch, width), batch.column(width).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            t = x @ beta
            sign = np.where(y > 0.5, 1.0, -1.0)
            _, slope, _ = BF.loss_terms(link, sign * t)
            p = BF.loss_terms("logit", -t)[1] if link == "logit" else np.exp(-BF.loss_terms(link, t)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(w * sign * slope)],
                                             [*batch.schema.names, "_p", "_u"])
    return run


def fit_binary_glm(df: DataFrame, label: str, features: list[str], fit_intercept: bool = True,
                   link: str = "logit", cluster: str | None = None, tol: float = 1e-12,
                   max_iter: int = 100, keep: tuple[str, ...] = ()) -> GlmFit:
    """M1 (logit), M4 (no constant), M5 (probit), M2 (cluster-robust when ``cluster``).

    ``keep`` names extra columns carried in ``GlmFit.scored`` (e.g. a group key for fitted-value
    summaries). ``converged`` in the table tells whether the slope per row came below ``tol``.
    """
    extra = tuple(dict.fromkeys([*([cluster] if cluster else []), *keep]))
    rows = BF.kept(BF.cells(df, features, label, group=True, extra=extra))
    every = [CONST, *features]
    plain = rows.select(*[f"_x{i}" for i in range(len(features))], "_y", "_key", "_w")
    flat = BF.Problem(active=(False,) * len(every))
    gram = BF.solve(plain, features, [flat], link, tol, 1, curvature=True).curvature
    first = 0 if fit_intercept else 1
    used = [first + i for i in independent(gram[first:, first:])] if gram is not None else []
    if not [i for i in used if i > 0]:
        raise ValueError("no column varies: there is nothing to estimate")
    problem = BF.Problem(active=tuple(i in used for i in range(len(every))))
    fits = BF.solve(plain, features, [problem], link, tol, max_iter, curvature=True)
    beta, done = fits.beta[0], bool(fits.converged[0])
    terms, k = [every[i] for i in used], len(used)
    cov = np.linalg.inv(fits.curvature[np.ix_(used, used)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _p double, _u double"
    scored = rows.mapInArrow(_scored(beta, len(features), link), schema)
    if cluster is not None:
        xs = [F.lit(1.0) if i == 0 else F.col(f"_x{i - 1}") for i in used]
        names = [f"_s{i}" for i in range(k)]
        per_g = scored.groupBy(F.col(f"`{cluster}`").alias("_cluster")).agg(
            F.sum("_w").alias("_n"), *[F.sum(F.col("_u") * x).alias(n) for x, n in zip(xs, names, strict=True)])
        per_g = BF.kept(per_g)
        sizes = per_g.agg(F.count(F.lit(1)).alias("g"), F.sum("_n").alias("n")).first()
        g, n = sizes["g"], sizes["n"]
        corr = (g / (g - 1.0)) * ((n - 1.0) / (n - k)) if g > 1 and n > k else float("nan")
        cov = corr * cov @ product_sums(per_g, names) @ cov
        per_g.unpersist()
    se = [math.sqrt(v) if v >= 0 else float("nan") for v in np.diag(cov)]
    table = []
    for i, t, s in zip(used, terms, se, strict=True):
        b = float(beta[i])
        z = b / s if s else float("nan")
        table.append((t, b, float(s), z, norm_sf2(z), b - Z_975 * s, b + Z_975 * s, done))
    table += [(t, *[None] * 6, done) for t in every[first:] if t not in terms]
    return GlmFit(df.sparkSession.createDataFrame(table, TABLE_SCHEMA), terms, rows, scored, done)


def formula_table(df: DataFrame, formula: str, cluster: str | None = None, **kw) -> DataFrame:
    """M3: the coefficient table of a model formula, such as `y ~ C(kind) * x - 1`."""
    d, names, f = design(df, formula, keep=(cluster,) if cluster else ())
    return coefficient_table(d, f.label, names, fit_intercept=f.intercept, cluster=cluster, **kw)


def coefficient_table(df: DataFrame, label: str, features: list[str], **kw) -> DataFrame:
    fit = fit_binary_glm(df, label, features, **kw)
    fit.release()
    return fit.table
