from pyspark.sql import functions as F

from panelcast.operators import folds as FO
from panelcast.operators.ordered import desc_running_sums, hash_rank, row_numbers


def _panel(spark, years, per_year=6):
    rows = [(f"r{y}_{i}", y, int(i == 0)) for y in years for i in range(per_year)]
    return spark.createDataFrame(rows, "row_key string, year int, y int")


def test_expanding_fold_ranges_match_recorded_forecast_years(spark):
    # min 1969, max 2009 -> mid 1989; recorded forecast years 1991-2009 / 1995-2009 / 2000-2009
    df = _panel(spark, range(1969, 2010))
    f = FO.expanding_folds(df, "year", (1, 5, 10)).collect()
    tests = {h: sorted(r.test_period for r in f if r.horizon == h) for h in (1, 5, 10)}
    assert tests[1] == list(range(1991, 2010))
    assert tests[5] == list(range(1995, 2010))
    assert tests[10] == list(range(2000, 2010))
    r = [x for x in f if x.horizon == 5 and x.train_end == 1989][0]
    assert (r.val_period, r.test_period) == (1994, 1995)


def test_expanding_role_counts(spark):
    df = _panel(spark, range(0, 11), per_year=4)
    folds = FO.expanding_folds(df, "year", (1,))
    c = {(r.train_end, r.role): (r.n, r.n_pos) for r in
         FO.expanding_role_counts(df, "year", "y", folds).collect()}
    assert c[(5, "train")] == (24, 6)
    assert c[(5, "val")] == (4, 1) and c[(5, "test")] == (4, 1)
    assert c[(5, "trainval")] == (28, 7)


def test_holdout_exact_stratified_counts(spark):
    rows = [(f"k{i}", int(i % 10 == 0)) for i in range(1003)]
    df = spark.createDataFrame(rows, "row_key string, y int")
    h = FO.stratified_holdout(df, "y", "row_key")
    counts = {(r.role, r.y): r["count"] for r in h.groupBy("role", "y").count().collect()}
    n_test = counts[("test", 0)] + counts[("test", 1)]
    assert n_test == 201  # ceil(0.2 * 1003)
    assert counts[("test", 1)] == 101 - 81  # 101 positives, train share floor(802*101/1003)=80 (+1 remainder)
    assert sum(counts.values()) == 1003


def test_hash_rank_matches_row_number(spark):
    from pyspark.sql import Window
    rows = [(f"k{i}", i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_key string, g int").withColumn("h", F.md5("row_key"))
    a = hash_rank(df, ["g"], "h", "rk", digits=2)
    b = df.withColumn("rk2", F.row_number().over(Window.partitionBy("g").orderBy("h")))
    j = a.join(b.select("row_key", "rk2"), "row_key")
    assert j.filter(F.col("rk") != F.col("rk2")).count() == 0


def test_kfold_balanced(spark):
    rows = [(f"k{i}", int(i % 7 == 0)) for i in range(700)]
    k = FO.stratified_kfold(spark.createDataFrame(rows, "row_key string, y int"), "y", "row_key", k=10)
    sizes = [r["count"] for r in k.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_leave_one_item_out_and_inner_folds(spark):
    rows = [("a", 1), ("a", 0), ("b", 0), ("c", 1), ("c", 1), ("c", 0)]
    df = spark.createDataFrame(rows, "item string, y int")
    c = {(r.held_item, r.role): (r.n, r.n_pos) for r in FO.leave_one_item_out_counts(df, "item", "y").collect()}
    assert c[("a", "test")] == (2, 1) and c[("a", "train")] == (4, 2)
    idx = FO.item_index(df, "item")
    t = idx.withColumn("inner", FO.inner_logo_fold(F.col("item_index"), F.lit(1)))
    got = {r.item: r.inner for r in t.collect()}
    assert got["a"] == 0 and got["c"] == 1  # 'b' (index 1) held out


def test_row_numbers_equal_one_window(spark):
    df = spark.createDataFrame([(k % 3, (k * 37) % 1000, k) for k in range(1000)], "g int, v int, k int").repartition(6)
    plan = row_numbers(df, ["v", "k"], parts=5)
    want = {r.k: r.rn for r in df.selectExpr("k", "row_number() OVER (ORDER BY v, k) AS rn").collect()}
    assert {r.k: r.row_number for r in plan.collect()} == want
    want = {r.k: r.rn for r in df.selectExpr("k", "row_number() OVER (PARTITION BY g ORDER BY v DESC, k) AS rn").collect()}
    got = row_numbers(df, ["g", F.col("v").desc(), "k"], by=["g"], out="rn", parts=7)
    assert {r.k: r.rn for r in got.collect()} == want
    assert row_numbers(df.limit(0), ["v"]).collect() == []


def test_running_sums_equal_one_window(spark):
    df = spark.createDataFrame([(k % 2 if k % 50 else 2, float(k * 7 % 401), k, 1) for k in range(400)], "g int, s double, a int, b int")
    df = df.groupBy("g", "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    want = {(r.g, r.s): (r.x, r.y) for r in df.selectExpr(
        "g", "s", "sum(a) OVER (PARTITION BY g ORDER BY s DESC) AS x", "sum(b) OVER (PARTITION BY g ORDER BY s DESC) AS y").collect()}
    for parts in (1, 6, 40):
        got = desc_running_sums(df, ["g"], "s", ["a", "b"], parts)
        assert {(r.g, r.s): (r.cum_a, r.cum_b) for r in got.collect()} == want


def test_folds_of_rows_in_order(spark):
    """Labels sorted by class in the order of first rows, dealt round; each class's rows consecutively."""
    labels = [1, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0]
    df = spark.createDataFrame(list(enumerate(labels)), "k int, y int").repartition(5)
    k = 4
    order = sorted(range(len(labels)), key=lambda i: (labels[i] != labels[0], i))
    deal = {c: [sum(labels[order[p]] == c for p in range(f, len(labels), k)) for f in range(k)] for c in (0, 1)}
    want = {}
    for c in (0, 1):
        folds = [f for f in range(k) for _ in range(deal[c][f])]
        want |= dict(zip([i for i, y in enumerate(labels) if y == c], folds, strict=True))
    got = FO.stratified_kfold_in_order(df, "y", ["k"], k)
    assert {r.k: r.fold for r in got.collect()} == want


def test_holdout_ranks_only_where_a_class_is_cut(spark):
    import hashlib

    from panelcast.operators.folds import stratified_holdout
    rows = [(f"k{k % 900}", int(k % 7 == 0), k) for k in range(1000)] + [("z", 2, -1), (None, 0, -2)]
    got = stratified_holdout(spark.createDataFrame(rows, "row_key string, y int, n int").repartition(6), "y", "row_key").collect()
    assert sorted(r.n for r in got) == sorted(n for *_, n in rows)
    sizes = {0: 858 - 686, 1: 143 - 114, 2: 1 - 1}  # 801 train rows: floors 686, 114, 0, the rest by largest remainder
    for y in (0, 1, 2):
        order = sorted(hashlib.md5("|".join(x for x in (k, "1337") if x is not None).encode()).hexdigest() for k, c, _ in rows if c == y)
        test = sorted(hashlib.md5("|".join(x for x in (r.row_key, "1337") if x is not None).encode()).hexdigest()
                      for r in got if r.y == y and r.role == "test")
        assert abs(len(test) - sizes[y]) <= 1 and test == order[:len(test)]
    assert sum(r.role == "test" for r in got) == 201


def test_small_tables_are_fitted_in_one_task(spark):
    from panelcast.operators import batch_fit as BF
    cells = spark.range(40).repartition(30)
    assert BF.dealt(cells, 40, 1000).rdd.getNumPartitions() == 1
    assert BF.dealt(cells, 40_000, 1000).rdd.getNumPartitions() == 40


def test_holdout_of_a_grouped_fit_does_not_deal_the_panel(spark, monkeypatch):
    from panelcast.operators import models as MD
    from panelcast.plans import workflows as W

    def dealt(*_):
        raise AssertionError("the panel is shuffled and sorted")
    monkeypatch.setattr(W, "spread", dealt)
    df = spark.createDataFrame([(f"k{k}", float(k % 2), int(k % 3 == 0 or k % 10 == 1)) for k in range(200)], "row_key string, a double, y int")
    got = W.holdout_benchmark(df, ["a"], models=(MD.ModelSpec.of("logistic", penalty=None, tol=1e-10),), group_rows=True)
    assert {r.metric: r.value for r in got.collect() if r.metric in ("tp", "fp", "fn", "tn")}.keys() == {"tp", "fp", "fn", "tn"}
