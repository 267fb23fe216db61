"""Result sinks (S4-S9): tables are written by Spark; text reports are
rendered with format_string over the (small) result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Result table with a header (csv) or as Parquet."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def forecast_summary_lines(summary: DataFrame) -> DataFrame:
    """S6: 'MODEL Results: Average AP Score: m (±s)' with 4 decimals."""
    return summary.select(
        "model", "horizon",
        F.format_string("%s Results:\nAverage AP Score: %.4f (±%.4f)", F.upper("model"),
                        F.col("mean_ap"), F.col("std_ap")).alias("line"))


def metric_report_lines(metrics: DataFrame) -> DataFrame:
    """One text line per (model, metric); fit minutes with 2 decimals."""
    fmt = F.when(F.col("metric") == "fit_minutes", F.format_string("%.2f", F.col("value"))) \
           .otherwise(F.format_string("%s", F.col("value")))
    return metrics.select("model", "metric", F.concat_ws(": ", F.col("metric"), fmt).alias("line"))


def ftest_report(ftests: DataFrame, level_means: DataFrame, path: str) -> None:
    """F tests and level means as two tables under one folder."""
    write_table(ftests, f"{path}/ftests")
    write_table(level_means, f"{path}/level_means")


# Order and layout of the rows of a printed class report.
REPORT_ROWS = ("0", "1", "accuracy", "macro avg", "weighted avg")


def class_report_text(report: DataFrame) -> DataFrame:
    """(model, text): the class report of each model as a printed table, two decimals."""
    place = F.array_position(F.array(*[F.lit(r) for r in REPORT_ROWS]), F.col("row"))
    full = F.format_string("%12s  %9.2f %9.2f %9.2f %9d", "row", "precision", "recall", "f1", F.col("support").cast("long"))
    short = F.format_string("%12s  %9s %9s %9.2f %9d", "row", F.lit(""), F.lit(""), "f1", F.col("support").cast("long"))
    line = F.when(F.col("row") == "accuracy", short).otherwise(full)
    # a blank line behind the header and behind the classes
    line = F.when(F.col("row").isin("0", "accuracy"), F.concat(F.lit("\n"), line)).otherwise(line)
    rows = F.array_sort(F.collect_list(F.struct(place.alias("place"), line.alias("line"))))
    head = F.format_string("%12s  %9s %9s %9s %9s", F.lit(""), F.lit("precision"), F.lit("recall"), F.lit("f1-score"), F.lit("support"))
    return report.groupBy("model").agg(rows.alias("_rows")).select(
        "model", F.concat(head, F.lit("\n"), F.array_join(F.col("_rows.line"), "\n"), F.lit("\n")).alias("text"))


def benchmark_report(tables: dict[str, DataFrame], tuned: tuple[str, ...] = ()) -> DataFrame:
    """(model, report): what the hold-out benchmark writes for a model, from its detail tables.

    The best parameters (of the ``tuned`` models), F1, balanced accuracy, class report and fit minutes.
    """
    m = tables["metrics"].groupBy("model").pivot("metric", ["f1", "balanced_accuracy", "fit_minutes"]).agg(F.first("value"))
    pairs = F.array_sort(F.collect_list(F.struct("param", "value")))
    best = tables["best_params"].groupBy("model").agg(F.array_join(F.transform(
        pairs, lambda p: F.concat(p["param"], F.lit(": "), p["value"])), ", ").alias("_best"))
    j = m.join(class_report_text(tables["class_report"]), "model").join(best, "model", "left")
    found = F.when(F.col("model").isin(*tuned), F.concat(F.lit("Best Parameters Found: {"), F.coalesce("_best", F.lit("")), F.lit("}\n"))
                   ).otherwise(F.lit("")) if tuned else F.lit("")
    return j.select("model", F.concat(
        found, F.format_string("F1 Score: %s\nBalanced Accuracy Score: %s\nClassification Report:\n", F.col("f1").cast("string"),
                               F.col("balanced_accuracy").cast("string")),
        "text", F.format_string("Model Fit Elapsed Time: %.2f Minutes", "fit_minutes")).alias("report"))
