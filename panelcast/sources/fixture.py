"""Stand-in adoption panel built from the driver's TPC-H-style tables.

unit   = customer nation, item = part brand, kind = part type,
period = quarter index since 1995Q1, y = returned large line.

The same definition exists as SQL text (PANEL_SQL) so that an external
engine can rebuild the identical panel for cross-checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.spec import PanelSpec

FEATURES = ("x1", "x2", "x3", "x4", "x5")

SPEC = PanelSpec(label="y", features=FEATURES, unit="unit", period="period",
                 item="item", cluster="unit", row_key="row_key", categorical=("kind",))

# Sentinel marking a missing part size in the stand-in panel.
SENTINEL_COLUMN = "p_size"
SENTINEL_VALUE = 50

PANEL_SQL = """
SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                     CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                     CAST(CAST(l_quantity AS INT) AS VARCHAR),
                     CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS VARCHAR))) AS row_key,
       c_nationkey AS unit, p_brand AS item, p_type AS kind, p_size,
       CAST((year(o_orderdate)-1995)*4 + quarter(o_orderdate) - 1 AS INT) AS period,
       CAST(l_returnflag='R' AND l_quantity>=40 AS INT) AS y,
       l_extendedprice/1e4 AS x1, l_discount AS x2, nullif(l_tax, 0.0) AS x3,
       c_acctbal AS x4, p_retailprice AS x5
FROM lineitem JOIN orders ON l_orderkey=o_orderkey
     JOIN customer ON o_custkey=c_custkey JOIN part ON l_partkey=p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in panel, declared with the DataFrame API.

    Joins are left to Catalyst: dimension sides are broadcast only when
    their estimated size is under spark.sql.autoBroadcastJoinThreshold
    (AQE re-checks at runtime); otherwise sort-merge joins on the keys.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size",
                                            "p_retailprice")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(p, li.l_partkey == p.p_partkey))
    key = F.md5(F.concat_ws(
        "|",
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")))
    return j.select(
        key.alias("row_key"),
        F.col("c_nationkey").alias("unit"),
        F.col("p_brand").alias("item"),
        F.col("p_type").alias("kind"),
        F.col("p_size"),
        ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).cast("int").alias("period"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 40)).cast("int").alias("y"),
        (F.col("l_extendedprice") / 1e4).alias("x1"),
        F.col("l_discount").alias("x2"),
        F.when(F.col("l_tax") != 0.0, F.col("l_tax")).alias("x3"),
        F.col("c_acctbal").alias("x4"),
        F.col("p_retailprice").alias("x5"),
    )
