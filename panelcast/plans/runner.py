"""Runs any workflow of any study from its configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators import clean as C
from panelcast.operators.encode import one_hot
from panelcast.plans import workflows as W
from panelcast.plans.studies import GBT_SPACE, PRUNED_SPACES, RF_SPACE, Study
from panelcast.sources.readers import load_study

WORKFLOWS = ("inference", "holdout", "forecast", "item_out", "significance", "cascades")


def design(panel: DataFrame, study: Study, workflow: str) -> tuple[DataFrame, list[str]]:
    """The panel with the workflow's features: covariates, dummies, elapsed periods.

    Dummies are made from the whole panel, so every fold has the same columns and a level
    that a fold lacks is 0 in it.  In a forecast the period itself is no feature; the
    periods elapsed since the first are, where the study has them.
    """
    dummies = study.dummies(workflow)
    gone = {study.label, *study.drop_from_x, *dummies}
    if workflow == "forecast":
        gone.add(study.period)
    features = [c for c in study.covariates if c not in gone]
    d = panel
    for c in dummies:
        d, names = one_hot(d, c, prefix=c, keep_source=True)
        features += names
    if workflow == "forecast" and study.elapsed:
        d = C.add_elapsed(d, study.period).drop("min_period", "max_period", "mid_period")
        features.append("elapsed")
    return d, features


def run_study(spark: SparkSession, study: Study, workflow: str, base_dir: str, schema=None, **options):
    """One workflow of one study; ``options`` go to the workflow's function."""
    if workflow not in WORKFLOWS:
        raise ValueError(f"unknown workflow {workflow}; one of {WORKFLOWS}")
    if workflow == "item_out" and study.item is None:
        raise ValueError(f"{study.name} follows a single item")
    panel = load_study(spark, study, base_dir, schema)
    if study.period in panel.columns:  # folds count in whole periods
        panel = panel.withColumn(study.period, F.col(f"`{study.period}`").cast("int"))
    if workflow == "cascades":
        return W.cascades(panel, study.unit, study.item, study.period, study.label, **options)
    if workflow == "inference":
        keep = tuple(f"{c}_" for c in study.dummies(workflow))
        covariates = [c for c in study.covariates if c not in study.dummies(workflow)]
        return W.inference_table(panel, study.label, covariates, one_hot=study.dummies(workflow),
                                 cluster=study.cluster, drop_prefixes=keep, **options)
    d, features = design(panel, study, workflow)
    if workflow in ("forecast", "item_out"):
        options = {"spaces": PRUNED_SPACES[study.name]} | options
    if workflow == "holdout":
        options = {"spaces": {"rf": RF_SPACE, "gbt": GBT_SPACE}} | options
    if workflow == "forecast":
        return W.forecast(d, features, period=study.period, label=study.label, **options)
    if workflow == "item_out":
        return W.leave_one_item_out(d, features, item=study.item, label=study.label, **options)
    columns = sorted(d.columns)
    d = d.withColumn("row_key", F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in columns])))
    if workflow == "holdout":
        return W.holdout_benchmark(d, features, row_key="row_key", label=study.label, **options)
    return W.significance(d, features, row_key="row_key", label=study.label, **options)
