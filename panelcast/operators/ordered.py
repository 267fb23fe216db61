"""Order-dependent statistics without one task per group.

A plain ``row_number() OVER (PARTITION BY stratum ORDER BY k)`` or a running
sum ``OVER (PARTITION BY fold ORDER BY score DESC)`` sends every row of a
stratum / fold to a single task.  With two classes or a dozen folds that is
a handful of tasks holding the whole table.  Here the rows are cut into
partitions that follow the order instead:

* `ranged`: one range partition of the total order, kept (lazily) so that every
  use of it sees the same partitions; `row_numbers` and `desc_running_sums` add the
  totals of the partitions before (one row per partition and group) to what runs
  inside a partition;
* `hash_rank`: for orders by a digest the digest's first characters are the partition.

The results equal the single-window form exactly.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B, _P, _I = "_pc_bucket", "_pc_part", "_pc_nth"


def ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """The rows range partitioned and sorted by ``order``, with their partition and their place in it.

    The frame is persisted, since two reads of a range partition that is sampled anew need not agree; nothing runs
    before the result is used. The number of partitions is that of the session's shuffles.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.withColumn(_P, F.spark_partition_id()).withColumn(
        _I, F.monotonically_increasing_id() - F.shiftleft(F.col(_P).cast("long"), 33))
    return rows.persist(StorageLevel.MEMORY_AND_DISK)


def _before(totals: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Totals of the partitions before each; one row per partition (and group), so it is broadcast."""
    w = Window.partitionBy(*by).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(totals.select(*by, _P, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_off_{s}") for s in sums]))


def row_numbers(df: DataFrame, order: list, by: list[str] | None = None, out: str = "row_number",
                parts: int | None = None) -> DataFrame:
    """O1: exact ``row_number() over (partition by ... order by order)``, from 1.

    Without ``by`` the place in the partition and the rows of the partitions before are the number, and nothing
    is shuffled behind the sort. Equal keys get distinct numbers in arbitrary order.
    """
    by = by or []
    rows = ranged(df, order, parts)
    offsets = _before(rows.groupBy(*by, _P).agg(F.count(F.lit(1)).alias("n")), by, ["n"])
    nth = F.row_number().over(Window.partitionBy(*by, _P).orderBy(_I)) if by else F.col(_I) + 1
    numbered = rows.withColumn("_pc_in", nth).join(offsets, [*by, _P])
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_off_n") + F.col("_pc_in")).cast("long").alias(out))


def hash_rank(df: DataFrame, strata: list[str], order_hex: Column | str,
              rank_col: str = "rank", digits: int = 4) -> DataFrame:
    """Exact ``row_number() over (partition by strata order by order_hex)``.

    ``order_hex`` must be a lower-case hex string (e.g. an md5 digest) so
    that its leading ``digits`` characters form a bucket that is monotone in
    the full order.  Equal keys get distinct ranks in arbitrary order, as
    with row_number; with a digest of a unique key there are no ties.

    The rows are shuffled and sorted once, by (strata, bucket); the offsets join back
    on the same keys, so the large side is not shuffled again. The bucket sizes are
    counted before the shuffle, over (strata, bucket) alone.
    """
    key = order_hex if isinstance(order_hex, str) else "_pc_key"
    d = df if isinstance(order_hex, str) else df.withColumn(key, order_hex)
    d = d.withColumn(_B, F.conv(F.substring(key, 1, digits), 16, 10).cast("long"))
    w = Window.partitionBy(*strata, _B).orderBy(key)
    ranked = d.withColumn("_pc_in", F.row_number().over(w))
    sizes = d.groupBy(*strata, _B).agg(F.count(F.lit(1)).alias("_pc_n"))
    wo = Window.partitionBy(*strata).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*strata, _B, F.coalesce(F.sum("_pc_n").over(wo), F.lit(0)).alias("_off_n"))
    return (ranked.join(offs, [*strata, _B])
            .withColumn(rank_col, (F.col("_off_n") + F.col("_pc_in")).cast("long"))
            .drop(_B, "_pc_in", "_off_n", "_pc_key"))


def desc_running_sums(df: DataFrame, groups: list[str], score: str, values: list[str],
                      parts: int | None = None) -> DataFrame:
    """Per distinct (groups, score): running sums of ``values`` over score descending.

    ``df`` must already hold one row per (groups, score) (aggregate first).
    Adds ``cum_<v>`` = sum of v over rows of the group with score >= this score. One sort by (groups, score)
    cuts the rows evenly, however they spread over groups.
    """
    rows = ranged(df, [*groups, F.col(score).desc()], parts)
    offsets = _before(rows.groupBy(*groups, _P).agg(*[F.sum(v).alias(v) for v in values]), groups, values)
    w = Window.partitionBy(*groups, _P).orderBy(_I).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = rows.select("*", *[F.sum(v).over(w).alias(f"_in_{v}") for v in values]).join(offsets, [*groups, _P])
    return d.select(*[c for c in df.columns],
                    *[(F.col(f"_off_{v}") + F.col(f"_in_{v}")).alias(f"cum_{v}") for v in values])
