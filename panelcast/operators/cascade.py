"""Adoption cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Seed and sample size of the plotted cascades.
CASCADE_SEED = 1333
CASCADE_SAMPLE = 10


def first_events(df: DataFrame, unit: str, item: str, period: str, label: str) -> DataFrame:
    """First adoption period per (unit, item); pairs that never adopt are absent."""
    return (df.filter(F.col(label) == 1).groupBy(unit, item)
              .agg(F.min(period).alias("first_period")))


def cascade_lists(first: DataFrame, unit: str, item: str) -> DataFrame:
    """Per cascade the time-ordered (period, node) list, rendered as 'p:u,...'.

    Each list holds one entry per adopting unit, so its length is bounded by
    the unit domain, not by the panel size.
    """
    ev = F.array_sort(F.collect_list(F.struct(F.col("first_period"), F.col(unit))))
    g = first.groupBy(item).agg(F.count(F.lit(1)).alias("n_nodes"), ev.alias("_ev"))
    txt = F.concat_ws(",", F.transform("_ev", lambda e: F.concat(
        e["first_period"].cast("string"), F.lit(":"), e[unit].cast("string"))))
    return g.select(item, "n_nodes", txt.alias("events"))


def sample_cascades(first: DataFrame, item: str, n: int = CASCADE_SAMPLE,
                    seed: int = CASCADE_SEED) -> DataFrame:
    """Seeded sample of n cascade ids: the n smallest md5(id|seed).

    A top-n: Spark keeps n rows per partition and merges (TakeOrderedAndProject).
    """
    ids = first.select(item).distinct()
    return (ids.withColumn("_h", F.md5(F.concat_ws("|", F.col(item).cast("string"), F.lit(str(seed)))))
               .orderBy("_h").limit(n).drop("_h"))


def sampled_events(first: DataFrame, item: str, n: int = CASCADE_SAMPLE,
                   seed: int = CASCADE_SEED) -> DataFrame:
    """C4: the plot data -- events of the sampled cascades (left-semi join)."""
    return first.join(F.broadcast(sample_cascades(first, item, n, seed)), item, "left_semi")
