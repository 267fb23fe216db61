from panelcast.sources import sinks as K


def test_sinks_write_and_render(spark, tmp_path):
    s = spark.createDataFrame([("original", 1, 0.16494, 0.05761)],
                              "model string, horizon int, mean_ap double, std_ap double")
    line = K.forecast_summary_lines(s).first().line
    assert line == "ORIGINAL Results:\nAverage AP Score: 0.1649 (±0.0576)"
    m = spark.createDataFrame([("rf", "fit_minutes", 0.0712), ("rf", "f1", 0.5)],
                              "model string, metric string, value double")
    lines = {r.metric: r.line for r in K.metric_report_lines(m).collect()}
    assert lines["fit_minutes"] == "fit_minutes: 0.07"
    out = tmp_path / "t"
    K.write_table(s, str(out))
    back = spark.read.option("header", True).csv(str(out))
    assert back.count() == 1 and "mean_ap" in back.columns
    K.ftest_report(s, m, str(tmp_path / "ft"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ft" / "ftests")).count() == 1


def test_benchmark_report(spark):
    tables = {
        "metrics": spark.createDataFrame([("logit", "f1", 0.25), ("logit", "balanced_accuracy", 0.5), ("logit", "fit_minutes", 1.256)],
                                         "model string, metric string, value double"),
        "class_report": spark.createDataFrame(
            [("logit", "1", 0.0857, 0.7522, 0.154, 444.0), ("logit", "0", 0.98, 0.59, 0.74, 8448.0), ("logit", "accuracy", None, None, 0.6, 8892.0),
             ("logit", "weighted avg", 0.93, 0.6, 0.71, 8892.0), ("logit", "macro avg", 0.53, 0.67, 0.45, 8892.0)],
            "model string, row string, precision double, recall double, f1 double, support double"),
        "best_params": spark.createDataFrame([("logit", "penalty", "l2", False), ("logit", "C", "0.1", False)],
                                             "model string, param string, value string, unsupported boolean")}
    lines = K.benchmark_report(tables, tuned=("logit",)).first().report.split("\n")
    assert lines == [
        "Best Parameters Found: {C: 0.1, penalty: l2}", "F1 Score: 0.25", "Balanced Accuracy Score: 0.5", "Classification Report:",
        "              precision    recall  f1-score   support", "",
        "           0       0.98      0.59      0.74      8448", "           1       0.09      0.75      0.15       444", "",
        "    accuracy                           0.60      8892", "   macro avg       0.53      0.67      0.45      8892",
        "weighted avg       0.93      0.60      0.71      8892", "Model Fit Elapsed Time: 1.26 Minutes"]
    assert K.benchmark_report(tables).first().report.startswith("F1 Score: 0.25\n")
