"""Query catalogue over the stand-in panel (one entry per operator family).

Each function takes (spark, sf_dir) and returns a DataFrame whose columns
and values match the SQL in plans/oracle.py.  Every query reads the given
tables in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.columns import rnd
from panelcast.session import cut_lineage
from panelcast.operators import clean as C
from panelcast.operators import encode as E
from panelcast.operators import folds as FO
from panelcast.operators import metrics as M
from panelcast.operators import models as MD
from panelcast.operators import scale as S
from panelcast.sources.fixture import (FEATURES, SENTINEL_COLUMN, SENTINEL_VALUE, SPEC,
                                       fixture_panel)

# The score columns treated as competing "models" in the metric queries.
SCORE_MODELS = ("x1", "x2", "x5")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_panel(fixture_panel(spark, sf_dir), SPEC,
                         sentinel=(SENTINEL_COLUMN, SENTINEL_VALUE), extra=(SENTINEL_COLUMN,))


def panel_clean(spark, sf_dir):
    return clean(spark, sf_dir)


def panel_elapsed(spark, sf_dir):
    d = C.add_elapsed(clean(spark, sf_dir), "period")
    return d.select("row_key", "period", "elapsed", "min_period", "max_period", "mid_period")


def dummies_kind(spark, sf_dir):
    d, names = E.one_hot(clean(spark, sf_dir).select("row_key", "kind"), "kind")
    return d.select("row_key", *names)


def dummies_aligned(spark, sf_dir):
    """The aligned columns of every expanding fold, and how many ones each split has in them."""
    c = clean(spark, sf_dir).select("unit", "period")
    folds = FO.expanding_folds(c, "period")
    return E.fold_dummies(c, "unit", "period", folds).drop("level", "baseline")


def interactions(spark, sf_dir):
    d = clean(spark, sf_dir).select("kind", C.interaction("x1", "x2"))
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"),
                                 rnd(F.sum(F.col("x1:x2"))).alias("sum_x1_x2"))


def scale_global(spark, sf_dir):
    c = clean(spark, sf_dir)
    st = S.fit_scaler(c, FEATURES)
    z = S.apply_scaler(c.select("row_key", *FEATURES), st, FEATURES, suffix="_z")
    return z.select("row_key", *[rnd(f"{f}_z").alias(f"{f}_z") for f in FEATURES])


def _h1_folds(c):
    return FO.expanding_folds(c, "period", horizons=(1,))


def scale_per_fold(spark, sf_dir):
    c = clean(spark, sf_dir)
    folds = _h1_folds(c)
    st = S.expanding_scaler_stats(c, "period", FEATURES, folds)
    test = c.select("row_key", "period", *FEATURES).join(
        F.broadcast(folds.select("horizon", "train_end", F.col("test_period").alias("period"))),
        "period")
    z = S.apply_scaler(test, st, FEATURES, by=["horizon", "train_end"], suffix="_z")
    return z.select("train_end", "row_key", *[rnd(f"{f}_z").alias(f"{f}_z") for f in FEATURES])


def holdout_rows(spark, sf_dir):
    h = FO.stratified_holdout(clean(spark, sf_dir).select("row_key", "y"), "y", "row_key")
    return h.select("row_key", "y", "role")


def holdout_counts(spark, sf_dir):
    return holdout_rows(spark, sf_dir).groupBy("role", "y").agg(F.count(F.lit(1)).alias("n"))


def kfold_counts(spark, sf_dir):
    k = FO.stratified_kfold(clean(spark, sf_dir).select("row_key", "y"), "y", "row_key", k=10)
    return k.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"))


def kfold_row_order(spark, sf_dir):
    """O1 + F2: consecutive stratified folds of the rows sorted by item, unit, period."""
    d = clean(spark, sf_dir).select("item", "unit", "period", "row_key", "y")
    k = FO.stratified_kfold_in_order(d, "y", ["item", "unit", "period", "row_key"], k=10)
    return k.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row"),
                                      F.max("row_number").alias("last_row"))


def _folds_expanding(h):
    def q(spark, sf_dir):
        c = clean(spark, sf_dir)
        folds = FO.expanding_folds(c, "period", horizons=(h,))
        return FO.expanding_role_counts(c, "period", "y", folds)
    return q


def folds_item_out(spark, sf_dir):
    return FO.leave_one_item_out_counts(clean(spark, sf_dir), "item", "y")


def folds_nested(spark, sf_dir):
    return FO.logo_fold_table(clean(spark, sf_dir), "item", "y") \
             .select("item", "item_index", "n", "n_pos", "n_inner_folds")


def _scored(spark, sf_dir):
    return M.predict_class(clean(spark, sf_dir).select("y", (F.col("x2") * 10).alias("score")))


def logo_inner_folds(spark, sf_dir):
    """for every held-out item, the inner fold of each other item (items squared rows, no data rows)."""
    t = FO.logo_fold_table(clean(spark, sf_dir), "item", "y")
    pairs = t.select("item", "item_index", F.explode(F.sequence(F.lit(0), F.col("n_inner_folds"))).alias("other_index"))
    pairs = pairs.filter("other_index <> item_index")
    return pairs.select("item", "other_index",
                        FO.inner_logo_fold(F.col("other_index"), F.col("item_index")).alias("inner_fold"))


def confusion(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))


def f1_bacc(spark, sf_dir):
    m = M.f1_balanced_accuracy(M.confusion(_scored(spark, sf_dir)))
    return m.select("tp", "fp", "fn", "tn", rnd("f1").alias("f1"),
                    rnd("balanced_accuracy").alias("balanced_accuracy"))


def class_report(spark, sf_dir):
    r = M.class_report(M.confusion(_scored(spark, sf_dir)))
    return r.select("row", rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                    rnd("f1").alias("f1"), F.col("support").cast("long").alias("support"))


def _fold_test_rows(c, folds):
    return c.join(F.broadcast(folds.select("train_end", F.col("test_period").alias("period"))),
                  "period").withColumnRenamed("period", "test_period")


def ap_by_fold(spark, sf_dir):
    c = clean(spark, sf_dir)
    t = _fold_test_rows(c.select("period", "y", F.col("x2").alias("score")), _h1_folds(c))
    ap = M.average_precision(t, ["train_end", "test_period"])
    return ap.select("train_end", "test_period", rnd("ap").alias("ap"), "n", "n_pos")


def ap_item_out(spark, sf_dir):
    ap = M.average_precision(clean(spark, sf_dir).select("item", "y", F.col("x2").alias("score")),
                             ["item"])
    return ap.select("item", rnd("ap").alias("ap"), "n", "n_pos")


def pr_curve(spark, sf_dir):
    pr = M.pr_curve(clean(spark, sf_dir).select("y", F.col("x2").alias("score")), [])
    return pr.select(rnd("precision").alias("precision"), rnd("recall").alias("recall"),
                     rnd("threshold").alias("threshold"))


def _model_fold_ap(spark, sf_dir):
    c = clean(spark, sf_dir)
    t = _fold_test_rows(c.select("period", "y", *SCORE_MODELS), _h1_folds(c))
    long = t.select("train_end", "test_period", "y",
                    F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score"))
                                       for m in SCORE_MODELS])))
    return M.average_precision(long, ["model", "train_end", "test_period"])


def ap_summary(spark, sf_dir):
    s = M.summarize(_model_fold_ap(spark, sf_dir), ["model"], "ap")
    return s.select("model", rnd("mean_ap").alias("mean_ap"), rnd("std_ap").alias("std_ap"),
                    "n_folds")


def ap_pivot(spark, sf_dir):
    p = M.pivot_models(_model_fold_ap(spark, sf_dir), "test_period", "model", list(SCORE_MODELS))
    return p.select("test_period", *[rnd(f"{m}_ap").alias(f"{m}_ap") for m in SCORE_MODELS])


# Class-weight schemes of the logistic search space.
CLASS_WEIGHT_SCHEMES = (None, "balanced", 3, 4, 5, 6, 7, 8, 9, 10)


def class_weights(spark, sf_dir):
    w = E.class_weight_table(clean(spark, sf_dir).select("y"), "y", CLASS_WEIGHT_SCHEMES)
    return w.select("scheme", "y", rnd("weight").alias("weight"), "n", rnd("total_weight").alias("total_weight"))


QUERIES = {
    "panel_clean": panel_clean,
    "panel_elapsed": panel_elapsed,
    "dummies_kind": dummies_kind,
    "dummies_aligned": dummies_aligned,
    "interactions": interactions,
    "scale_global": scale_global,
    "scale_per_fold": scale_per_fold,
    "holdout_counts": holdout_counts,
    "holdout_rows": holdout_rows,
    "kfold_counts": kfold_counts,
    "kfold_row_order": kfold_row_order,
    "folds_expanding_h1": _folds_expanding(1),
    "folds_expanding_h5": _folds_expanding(5),
    "folds_expanding_h10": _folds_expanding(10),
    "folds_item_out": folds_item_out,
    "folds_nested": folds_nested,
    "logo_inner_folds": logo_inner_folds,
    "confusion": confusion,
    "f1_bacc": f1_bacc,
    "class_report": class_report,
    "ap_by_fold": ap_by_fold,
    "ap_item_out": ap_item_out,
    "pr_curve": pr_curve,
    "ap_summary": ap_summary,
    "ap_pivot": ap_pivot,
    "class_weights": class_weights,
}


# ---------------------------------------------------------------- inference

def _kind_design(spark, sf_dir, drop_first=True):
    c = clean(spark, sf_dir)
    d, names = E.one_hot(c.select("unit", "y", "kind", "x2"), "kind", drop_first=drop_first,
                         keep_source=True)
    return d, names


def _coef_cols(t):
    return t.select("term", rnd("coef", 5).alias("coef"), rnd("std_err", 5).alias("std_err"),
                    rnd("z", 5).alias("z"), rnd("ci_low", 5).alias("ci_low"),
                    rnd("ci_high", 5).alias("ci_high"))


def logit_saturated(spark, sf_dir):
    from panelcast.operators.inference import coefficient_table
    d, names = _kind_design(spark, sf_dir)
    return _coef_cols(coefficient_table(d, "y", names))


def logit_cluster(spark, sf_dir):
    from panelcast.operators.inference import coefficient_table
    d, names = _kind_design(spark, sf_dir)
    return _coef_cols(coefficient_table(d, "y", names, cluster="unit"))


def probit_saturated(spark, sf_dir):
    from panelcast.operators.inference import fit_binary_glm
    d, names = _kind_design(spark, sf_dir, drop_first=False)
    fit = fit_binary_glm(d, "y", names, fit_intercept=False, link="probit", keep=("kind",))
    n = F.sum("_w")
    out = cut_lineage(fit.scored.groupBy("kind").agg(n.cast("long").alias("n"),
                                                     rnd(F.sum(F.col("_w") * F.col("_p")) / n).alias("fitted_p")))
    fit.release()
    return out


def logit_no_const(spark, sf_dir):
    from panelcast.operators.inference import coefficient_table
    d, names = _kind_design(spark, sf_dir, drop_first=False)
    return _coef_cols(coefficient_table(d, "y", names, fit_intercept=False))


def probit_coef(spark, sf_dir):
    from panelcast.operators.inference import coefficient_table
    d, names = _kind_design(spark, sf_dir, drop_first=False)
    return _coef_cols(coefficient_table(d, "y", names, fit_intercept=False, link="probit"))


def coef_prefix_filter(spark, sf_dir):
    """Formula logit y ~ C(kind) * hi, then drop every term starting with 'kind_'."""
    from panelcast.operators.inference import coefficient_table
    d, names = _kind_design(spark, sf_dir)
    d = d.withColumn("hi", (F.col("x2") > 0.05).cast("int"))
    inter = [C.interaction(n, "hi") for n in names]
    d = d.select("*", *inter)
    feats = [*names, "hi", *[f"{n}:hi" for n in names]]
    t = coefficient_table(d, "y", feats)
    return _coef_cols(C.without_prefix(t, "term", "kind_"))


# ---------------------------------------------------------------- significance

ANOVA_PARAMS = ("kind", "unit", "x3", "x2")


def anova_f(spark, sf_dir):
    from panelcast.operators.anova import oneway_anova
    a = oneway_anova(fixture_panel(spark, sf_dir), ANOVA_PARAMS, "x1", with_p=False)
    return a.select("param", "k", "n", rnd("f_stat", 4).alias("f_stat"))


def anova_p(spark, sf_dir):
    """H-F with its p-value, on a metric that the parameters move little, so that the tails are not nought."""
    from panelcast.operators.anova import oneway_anova
    a = oneway_anova(fixture_panel(spark, sf_dir), ANOVA_PARAMS, "x4")
    return a.select("param", "k", "n", rnd("f_stat", 4).alias("f_stat"), rnd("p_value").alias("p_value"))


def logit_formula(spark, sf_dir):
    """M3: the coefficient table of a formula with a categorical factor, an interaction and no intercept."""
    from panelcast.operators.inference import formula_table
    d = clean(spark, sf_dir).select("y", "kind", (F.col("x2") > 0.05).cast("int").alias("hi"))
    return _coef_cols(formula_table(d, "y ~ C(kind) + C(kind):hi - 1"))


def level_means(spark, sf_dir):
    from panelcast.operators.anova import level_means as lm
    m = lm(fixture_panel(spark, sf_dir), ANOVA_PARAMS, "x1")
    return m.select("param", "level", "n", rnd("mean_metric").alias("mean_metric"), "rank")


# ---------------------------------------------------------------- cascades

def _first(spark, sf_dir):
    from panelcast.operators.cascade import first_events
    return first_events(clean(spark, sf_dir), "unit", "item", "period", "y")


def first_event(spark, sf_dir):
    return _first(spark, sf_dir)


def cascade_lists(spark, sf_dir):
    from panelcast.operators.cascade import cascade_lists as cl
    return cl(_first(spark, sf_dir), "unit", "item")


def cascade_sample(spark, sf_dir):
    from panelcast.operators.cascade import sampled_events
    return sampled_events(_first(spark, sf_dir), "item").select("item", "unit", "first_period")


QUERIES.update({
    "logit_saturated": logit_saturated,
    "logit_cluster": logit_cluster,
    "probit_saturated": probit_saturated,
    "logit_no_const": logit_no_const,
    "probit_coef": probit_coef,
    "coef_prefix_filter": coef_prefix_filter,
    "logit_formula": logit_formula,
    "anova_f": anova_f,
    "anova_p": anova_p,
    "level_means": level_means,
    "first_event": first_event,
    "cascade_lists": cascade_lists,
    "cascade_sample": cascade_sample,
})


# ---------------------------------------------------------------- model workflows (rows-only checks)

MODEL_FEATURES = [*FEATURES, "elapsed"]


def _model_panel(spark, sf_dir):
    return C.add_elapsed(clean(spark, sf_dir), "period").drop("min_period", "max_period", "mid_period")


# Models whose fitted values are the training means of each kind, so that SQL can tell
# their scores: logistic regression without a penalty, and one tree grown to the end.
KIND_MODELS = {
    "logit": lambda: MD.ModelSpec.of("logistic", penalty=None, tol=1e-10),
    "tree": lambda: MD.ModelSpec.of("rf", n_estimators=1, max_depth=None, max_features=None, bootstrap=False),
}
SCORE_DIGITS = 6


def _kind_panel(spark, sf_dir):
    d, names = E.one_hot(clean(spark, sf_dir).select("row_key", "item", "period", "y", "kind"), "kind")
    return d, names


def _named(model):
    return F.lit(model).alias("model")


def _forecast_kind(model):
    def q(spark, sf_dir):
        """W3, every horizon and fold: AP of the model's forecasts from the kind dummies."""
        from panelcast.plans.workflows import forecast
        d, names = _kind_panel(spark, sf_dir)
        ap = forecast(d, names, models=(KIND_MODELS[model](),), group_rows=True, digits=SCORE_DIGITS,
                       parallelism=4)
        return ap.select(_named(model), "horizon", "train_end", "test_period", rnd("ap").alias("ap"), "n", "n_pos")
    return q


def _item_out_kind(model):
    def q(spark, sf_dir):
        """AP on each held-out item of the model fitted on the other items."""
        from panelcast.plans.workflows import leave_one_item_out
        d, names = _kind_panel(spark, sf_dir)
        ap = leave_one_item_out(d, names, models=(KIND_MODELS[model](),), group_rows=True, digits=SCORE_DIGITS,
                       parallelism=4)
        return ap.select(_named(model), F.col("held_item").alias("item"), rnd("ap").alias("ap"), "n", "n_pos")
    return q


def holdout_kind(spark, sf_dir):
    """Both models on the stratified 80/20 split."""
    from panelcast.plans.workflows import holdout_benchmark
    d, names = _kind_panel(spark, sf_dir)
    specs = {m: f() for m, f in KIND_MODELS.items()}
    out = holdout_benchmark(d, names, models=tuple(specs.values()), group_rows=True, digits=SCORE_DIGITS,
                       parallelism=4)
    label = F.lit(None).cast("string")
    for m, spec in specs.items():
        label = F.when(F.col("model") == spec.label(), F.lit(m)).otherwise(label)
    return out.filter("metric <> 'fit_minutes'").select(label.alias("model"), "metric", rnd("value").alias("value"))


def _grid_rows(spark, sf_dir):
    d, names = E.one_hot(clean(spark, sf_dir).select("row_key", "y", "kind"), "kind")
    folds = [({str(k) for k in range(10) if k != t}, {str(t)}) for t in range(10)]
    return FO.stratified_kfold(d, "y", "row_key", k=10), names, folds


def grid_logit(spark, sf_dir):
    """Every distinct problem of the logistic space, 10 folds each, fitted together."""
    from panelcast.operators import search as SE
    from panelcast.plans.studies import LOGISTIC_SPACE
    d, names, folds = _grid_rows(spark, sf_dir)
    trials = SE.dedupe_logistic(SE.grid(LOGISTIC_SPACE), by_solver=True)
    ap = SE.logistic_ap(SE.specs("logistic", trials), d, "fold", folds, names, group_rows=True, digits=SCORE_DIGITS, details=True)
    mean = ap.groupBy("trial").agg(rnd(F.avg("ap")).alias("mean_ap"), F.max("residual").alias("residual"),
                                   F.min(F.col("converged").cast("int")).cast("boolean").alias("converged"))
    return SE.trials_frame(spark, trials).join(mean, "trial")


def grid_logit_free(spark, sf_dir):
    """The unpenalised problems of the logistic space, the AP of each on each of 10 folds."""
    from panelcast.operators import search as SE
    from panelcast.plans.studies import LOGISTIC_COMMON
    d, names, folds = _grid_rows(spark, sf_dir)
    trials = [{"penalty": None, "class_weight": w, "fit_intercept": i}
              for w in LOGISTIC_COMMON["class_weight"] for i in LOGISTIC_COMMON["fit_intercept"]]
    ap = SE.logistic_ap(SE.specs("logistic", trials), d, "fold", folds, names, group_rows=True, digits=SCORE_DIGITS)
    named = [(i, "none" if t["class_weight"] is None else t["class_weight"] if t["class_weight"] == "balanced"
              else str(t["class_weight"][1]), t["fit_intercept"]) for i, t in enumerate(trials)]
    each = spark.createDataFrame(named, "trial int, scheme string, intercept boolean")
    return ap.join(F.broadcast(each), "trial").select("scheme", "intercept", "fold", rnd("ap").alias("ap"), "n", "n_pos")


def item_out_nested(spark, sf_dir):
    """for every held-out item and every other one, the AP on the other of a model fitted without both."""
    from panelcast.operators import batch_fit as BF
    from panelcast.operators import search as SE
    d, names = _kind_panel(spark, sf_dir)
    items = [r["item"] for r in FO.item_index(d, "item").orderBy("item_index").collect()]
    pairs = [(a, b) for a in items for b in items if a != b]
    every = frozenset(map(str, items))
    rows = BF.kept(BF.cells(d, names, "y", "item", group=True))
    spec = KIND_MODELS["logit"]()
    ap = SE.batch_ap(rows, names, [(spec, every - {str(a), str(b)}, frozenset({str(b)}), {}) for a, b in pairs], SCORE_DIGITS)
    rows.unpersist()
    each = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "problem int, item string, inner_item string")
    return ap.join(F.broadcast(each), "problem").select("item", "inner_item", rnd("ap").alias("ap"), "n", "n_pos")


def boost_stumps(spark, sf_dir):
    """One boosted stump on the kind dummies for each setting of the regularisation, grown together."""
    from panelcast.operators import batch_fit as BF
    from panelcast.operators import hist_trees as HT
    from panelcast.plans.studies import BOOST_SETTINGS
    d, names = E.one_hot(clean(spark, sf_dir).select("y", "kind"), "kind", keep_source=True)
    problems = [HT.TreeProblem(trees=1, depth=1, reg_lambda=lam, reg_alpha=alpha, min_child_weight=child, gamma=gamma,
                               weights=(1.0, float(spw))) for lam, alpha, child, gamma, spw in BOOST_SETTINGS]
    rows = BF.kept(BF.cells(d, names, "y", group=True))
    grown = HT.fit(rows, names, problems)
    grown.release()
    rows.unpersist()
    kinds, out = d.select("kind", *names).distinct(), None
    for k in range(len(problems)):  # one branch per setting
        s = HT.predict(kinds, grown.fits, ["kind"], k).select(F.lit(k).alias("setting"), "kind", rnd("score").alias("score"))
        out = s if out is None else out.unionByName(s)
    return out


def forecast_gbt(spark, sf_dir):
    """W3, every horizon and fold: boosted trees at their defaults (100 rounds, depth 6), all folds fitted together."""
    from panelcast.plans.workflows import forecast
    return forecast(_model_panel(spark, sf_dir), MODEL_FEATURES, models=("gbt_default",))


def holdout_models(spark, sf_dir):
    """Logistic and boosted trees at their defaults, a random forest of depth 10, on the stratified 80/20 split."""
    from panelcast.plans.workflows import holdout_benchmark
    return holdout_benchmark(_model_panel(spark, sf_dir), MODEL_FEATURES, models=("original", "rf_d10", "gbt_default"))


def param_ftest(spark, sf_dir):
    """40 seeded logistic trials, 3-fold AP, F test per parameter."""
    from panelcast.plans.workflows import significance
    ft, _, _ = significance(_model_panel(spark, sf_dir), MODEL_FEATURES, family="logistic")
    return ft


QUERIES.update({
    "grid_logit": grid_logit,
    "grid_logit_free": grid_logit_free,
    "item_out_nested": item_out_nested,
    "boost_stumps": boost_stumps,
    "forecast_logit": _forecast_kind("logit"),
    "forecast_rf": _forecast_kind("tree"),
    "forecast_gbt": forecast_gbt,
    "item_out_logit": _item_out_kind("logit"),
    "item_out_rf": _item_out_kind("tree"),
    "holdout_kind": holdout_kind,
    "holdout_models": holdout_models,
    "param_ftest": param_ftest,
})
