"""Connected components of a link table by alternating star contraction.

Every step is a grouped minimum joined back to the links, so the hub of a large component
is never one task's group: the minimum is pre-aggregated and the join's hot side is split by
AQE. Lineage is cut once per round with a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import cut_lineage


def _parts(rows: int) -> int:
    """Partitions that so many links need; a round has many small stages."""
    return max(1, -(-rows // 100_000))


def _open(edges: DataFrame, parts: int) -> int:
    """Nodes that do not hang directly, and by one link only, below a root: 0 if all are stars."""
    ends = edges.select(F.inline(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))))
    per = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return per.filter("below > 1 OR (below = 1 AND above = 1)").coalesce(parts).count()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    # u > v holds for every row
    low = edges.groupBy("u").agg(F.min("v").alias("_m"))
    others = edges.join(low, "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return others.unionByName(low.select("u", F.col("_m").alias("v"))).coalesce(parts).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable.

    Self links, repeats and both directions are allowed; nodes without links are absent;
    rows with a null end are ignored. Runs until every component is a star around its root.
    """
    edges = (links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
             .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = cut_lineage(edges.distinct())
    parts = _parts(edges.count())
    while _open(edges, parts):
        larger = cut_lineage(_large_star(edges).coalesce(parts))
        edges = cut_lineage(_small_star(larger, parts).coalesce(parts))
    roots = edges.select(F.col("v").alias("node")).distinct()
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
