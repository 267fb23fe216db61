"""Split and fold operators.

Folds are small DataFrames describing row sets by predicate (period range,
item key, hash rank), never materialised copies of the panel.  Statistics
over folds are computed from per-period / per-item partial aggregates so
the raw panel is scanned once regardless of the number of folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.ordered import hash_rank, row_numbers

# Seed and hold-out share used by the hold-out benchmark.
DEFAULT_SEED = 1337
DEFAULT_TEST_SIZE = 0.2
# Hex digits by which the hold-out split finds where a class is cut: one of 65,536 shares of a class is ranked.
CUT_DIGITS = 4


def order_key(row_key: str, seed: int = DEFAULT_SEED) -> Column:
    """Deterministic pseudo-random order: md5 of the row key and the seed."""
    return F.md5(F.concat_ws("|", F.col(row_key).cast("string"), F.lit(str(seed))))


def _stratified_test_counts(counts: DataFrame, label: str, test_size: float) -> DataFrame:
    """Per class number of test rows (scikit-learn stratified shuffle-split sizes).

    n_test = ceil(test_size * n); the train share n - n_test is allocated by
    floor(n_train * n_c / n), leftover rows going to the largest remainders
    (ties: lower class first); test = class count - train count.
    The input has one row per class, so the windows run over a tiny table.
    """
    w_all = Window.partitionBy()
    c = counts.withColumn("_n", F.sum("_n_class").over(w_all))
    c = c.withColumn("_n_test", F.ceil(F.lit(test_size) * F.col("_n")).cast("long"))
    c = c.withColumn("_n_train", F.col("_n") - F.col("_n_test"))
    num = F.col("_n_class") * F.col("_n_train")
    c = c.withColumn("_floor", F.floor(num / F.col("_n")).cast("long")) \
         .withColumn("_rem", F.pmod(num, F.col("_n")))
    c = c.withColumn("_short", F.col("_n_train") - F.sum("_floor").over(w_all))
    w_rem = Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(label).asc())
    c = c.withColumn("_extra", (F.row_number().over(w_rem) <= F.col("_short")).cast("long"))
    return c.select(label, "_n_class",
                    (F.col("_n_class") - F.col("_floor") - F.col("_extra")).alias("_k_test"))


def stratified_holdout(df: DataFrame, label: str, row_key: str, test_size: float = DEFAULT_TEST_SIZE,
                       seed: int = DEFAULT_SEED, role_col: str = "role") -> DataFrame:
    """stratified train/test split with exact per-class test counts.

    Row order within a class is md5(row_key|seed); the first k_c rows of
    class c are test.  Counts per class and leading digits of the md5 (a bounded
    table) tell the digits at which a class is cut, so only the rows with
    these digits are ranked; all others are not shuffled.
    """
    d = df.withColumn("_ok", order_key(row_key, seed))
    head = F.substring("_ok", 1, CUT_DIGITS)
    per = d.groupBy(label, head.alias("_head")).agg(F.count(F.lit(1)).alias("_n_head"))
    counts = per.groupBy(label).agg(F.sum("_n_head").alias("_n_class"))
    sizes = _stratified_test_counts(counts, label, test_size)
    upto = Window.partitionBy(label).orderBy("_head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (per.withColumn("_upto", F.sum("_n_head").over(upto)).join(F.broadcast(sizes), label)
           .groupBy(label).agg(  # the digits are null where a class has no test row
               F.min(F.when((F.col("_k_test") > 0) & (F.col("_upto") >= F.col("_k_test")),
                            F.struct("_head", (F.col("_k_test") - F.col("_upto") + F.col("_n_head")).alias("_left")))).alias("_cut"))
           .select(label, F.col("_cut._head").alias("_cut"), F.col("_cut._left").alias("_left")))
    # ``cut`` has one row per class: broadcasting it is bounded by the label domain.
    j = d.join(F.broadcast(cut), label)
    at_cut = F.coalesce(head == F.col("_cut"), F.lit(False))
    clear = j.filter(~at_cut).withColumn(role_col, F.when(head < F.col("_cut"), F.lit("test")).otherwise(F.lit("train")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_ok"))
    edge = j.filter(at_cut).withColumn(role_col, F.when(rank <= F.col("_left"), F.lit("test")).otherwise(F.lit("train")))
    return clear.unionByName(edge).drop("_cut", "_left", "_ok")


def stratified_kfold(df: DataFrame, label: str, row_key: str, k: int = 10,
                     seed: int = DEFAULT_SEED, fold_col: str = "fold") -> DataFrame:
    """stratified k folds (0..k-1); class c rows dealt round-robin in hash order."""
    ranked = hash_rank(df.withColumn("_ok", order_key(row_key, seed)), [label], "_ok", "_rank")
    return ranked.withColumn(fold_col, F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")) \
                 .drop("_rank", "_ok")


def stratified_kfold_in_order(df: DataFrame, label: str, order: list, k: int = 10, fold_col: str = "fold",
                              number_col: str = "row_number") -> DataFrame:
    """O1 + F2: stratified k folds of rows as they stand in ``order``, unshuffled.

    Classes are taken in the order of their first rows. Of all labels sorted by class, every k-th from i on belongs to
    fold i: that gives each fold's number of rows of a class; a class's rows go to the folds one after another.
    Also adds the row's number in the order. Class sizes and first rows come from one aggregate of a row per class.
    """
    rows = row_numbers(df, order, out=number_col)
    ranked = row_numbers(rows, [label, number_col], by=[label], out="_rank")
    per = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min(number_col).alias("_first"))
    # one row per class from here on
    seen = Window.partitionBy().orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_lo", F.coalesce(F.sum("_n").over(seen), F.lit(0)))

    def upto(place):  # rows of fold i among the first `place` sorted labels
        return lambda i: F.floor((place - 1 - i) / k) + 1
    hi, lo = F.col("_lo") + F.col("_n"), F.col("_lo")
    share = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.greatest(upto(hi)(i), F.lit(0)) - F.greatest(upto(lo)(i), F.lit(0)))
    per = per.select(label, share.alias("_share"))
    joined = ranked.join(F.broadcast(per), label)
    ends = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.aggregate(
        F.slice("_share", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    fold = F.size(F.filter(ends, lambda e: e < F.col("_rank")))
    return joined.withColumn(fold_col, fold.cast("int")).drop("_share", "_rank")


def period_counts(df: DataFrame, period: str, label: str) -> DataFrame:
    """Rows and positives per period: the partial aggregate all expanding-fold stats use."""
    return df.groupBy(period).agg(F.count(F.lit(1)).alias("n"),
                                  F.sum(F.col(label).cast("long")).alias("n_pos"))


def expanding_folds(df: DataFrame, period: str, horizons=(1, 5, 10),
                    label: str | None = None) -> DataFrame:
    """expanding-origin folds.

    For horizon h and origin T in [mid, max - h]: train = period <= T,
    validation = T + h, test = T + h + 1 (periods T+1 .. T+h-1 unused).
    mid = min + (max - min) // 2.  Folds whose test period has no rows are
    dropped (A2).  Bounds and presence both come from one per-period
    aggregate (one pass); the fold table is bounded by periods x horizons.
    """
    per = df.groupBy(period).agg(F.count(F.lit(1)).alias("_n"))
    present = per.select(F.col(period).alias("test_period"))
    b = per.agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    b = b.withColumn("_mid", F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) / 2).cast("int"))
    hs = F.array(*[F.lit(int(h)) for h in horizons])
    f = b.select("_lo", "_mid", "_hi", F.explode(hs).alias("horizon"))
    f = f.filter(F.col("_hi") - F.col("horizon") >= F.col("_mid"))
    f = f.select("horizon", F.col("_lo").alias("train_start"),
                 F.explode(F.sequence(F.col("_mid"), F.col("_hi") - F.col("horizon"))).alias("train_end"))
    f = f.withColumn("val_period", F.col("train_end") + F.col("horizon")) \
         .withColumn("test_period", F.col("train_end") + F.col("horizon") + 1)
    return f.join(present, "test_period").select(
        "horizon", "train_start", "train_end", "val_period", "test_period")


def role_of(period: Column, folds_prefix: str = "") -> Column:
    """Role of a row in an expanding fold (null = not used by the fold)."""
    p = folds_prefix
    return (F.when(period <= F.col(f"{p}train_end"), F.lit("train"))
            .when(period == F.col(f"{p}val_period"), F.lit("val"))
            .when(period == F.col(f"{p}test_period"), F.lit("test")))


def expanding_role_counts(df: DataFrame, period: str, label: str, folds: DataFrame) -> DataFrame:
    """F4/A2/U1 stats: (horizon, train_end, role, n, n_pos) from per-period aggregates.

    'trainval' is the stacked train + validation set that tuned models refit on.
    Both join sides are bounded by the number of distinct periods.
    """
    pc = period_counts(df, period, label)
    j = folds.join(pc, (pc[period] <= folds.train_end) | (pc[period] == folds.val_period)
                   | (pc[period] == folds.test_period))
    j = j.withColumn("role", role_of(F.col(period)))
    roles = j.withColumn("role", F.explode(F.when(F.col("role").isin("train", "val"),
                                                  F.array(F.col("role"), F.lit("trainval")))
                                           .otherwise(F.array(F.col("role")))))
    return roles.groupBy("horizon", "train_end", "val_period", "test_period", "role").agg(
        F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"))


def item_counts(df: DataFrame, item: str, label: str) -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias("n"),
                                F.sum(F.col(label).cast("long")).alias("n_pos"))


def leave_one_item_out_counts(df: DataFrame, item: str, label: str) -> DataFrame:
    """F5 stats: per held-out item, (held_item, role, n, n_pos).

    test = rows of the item, train = all other rows = total - item; derived
    from one per-item aggregate, so no panel copy per fold.
    """
    ic = item_counts(df, item, label)
    total = ic.agg(F.sum("n").alias("_tn"), F.sum("n_pos").alias("_tp"))
    ic = ic.crossJoin(F.broadcast(total))  # one row
    rows = F.array(
        F.struct(F.lit("test").alias("role"), F.col("n").alias("n"), F.col("n_pos").alias("n_pos")),
        F.struct(F.lit("train").alias("role"), (F.col("_tn") - F.col("n")).alias("n"),
                 (F.col("_tp") - F.col("n_pos")).alias("n_pos")))
    return ic.select(F.col(item).alias("held_item"), F.inline(rows))


def item_index(df: DataFrame, item: str) -> DataFrame:
    """Dense 0-based index of each distinct item in key order."""
    d = row_numbers(df.select(item).distinct(), [item], out="item_index")
    return d.withColumn("item_index", (F.col("item_index") - 1).cast("int"))


def inner_logo_fold(item_idx: Column, held_idx: Column) -> Column:
    """leave-one-group-out fold id of an item once ``held`` is removed.

    Items keep their dense order; those after the held-out item shift down by
    one, giving fold ids 0..n_items-2 without materialising item pairs.
    """
    return (item_idx - F.when(item_idx > held_idx, 1).otherwise(0)).cast("int")


def logo_fold_table(df: DataFrame, item: str, label: str) -> DataFrame:
    """F5/F6 fold table: per item its index, counts and the number of inner folds."""
    ic = item_counts(df, item, label)
    idx = item_index(df, item)
    total = ic.agg((F.count(F.lit(1)) - 1).cast("int").alias("n_inner_folds"))
    return ic.join(idx, item).crossJoin(F.broadcast(total))  # one row
