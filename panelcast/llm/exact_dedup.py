"""Exact dedup by a heavy-hitter split (DataFrame functions only).

1. Each text becomes the SHA-256 of its normalised form (one scan of the texts;
   everything after works on (id, digest) rows).
2. A Misra-Gries summary (Spark's frequent-items sketch, `approx_top_k_*`) of
   `track` counters per group of partitions, merged in two levels, names the
   candidate frequent digests: every digest with more than about 4 / track of all
   rows is among them.
3. Candidates are counted exactly; the verified ones (at most `winners` rows, so
   the broadcast has a fixed bound) are removed from the rest map-side.
4. The remaining digests, none of them frequent, meet in one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import SPACE, table
from panelcast.session import cut_lineage


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _digest): digest of the text with each run of white space made one space."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("_digest"))


def frequent(rows: DataFrame, track: int, winners: int) -> DataFrame:
    """(_digest, keep_id, group_size) of verified frequent digests: at most `winners` rows."""
    parts = (rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("_part"))
             .agg(F.expr(f"approx_top_k_accumulate(_digest, {track})").alias("_sketch")))
    # keyed, so that empty partitions send no empty sketch
    merged = (parts.groupBy(F.pmod("_part", F.lit(1)).alias("_all"))
              .agg(F.expr(f"approx_top_k_combine(_sketch, {track})").alias("_sketch")))
    candidates = merged.select(F.explode(F.expr(f"approx_top_k_estimate(_sketch, {winners})")).alias("_top"))
    candidates = (candidates.filter("_top.count > 1").select(F.col("_top.item").alias("_digest")))
    counted = (rows.join(F.broadcast(candidates), "_digest", "left_semi")
               .groupBy("_digest")
               .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return counted.filter("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                track: int = 8192, winners: int = 2048) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Of equal texts the
    smallest non-null id stays. Rows that repeat that id all carry kept = true (the id is
    the key); where every id of a group is null, keep_id is null and the rows are kept.
    An empty table gives an empty result. Other columns, whatever their names, are ignored.
    `track` and `winners` bound the sketch and the broadcast; they steer only which path a
    digest takes, never the result.
    """
    rows = cut_lineage(digests(docs, id_col, text_col))
    heavy = cut_lineage(frequent(rows, track, winners))
    by_map = rows.join(F.broadcast(heavy), "_digest")
    rest = rows.join(F.broadcast(heavy), "_digest", "left_anti")
    group = Window.partitionBy("_digest")
    by_shuffle = (rest.withColumn("keep_id", F.min("_id").over(group))
                  .withColumn("group_size", F.count(F.lit(1)).over(group)))
    both = by_map.select("_id", "keep_id", "group_size", "_digest").unionByName(
        by_shuffle.select("_id", "keep_id", "group_size", "_digest"))
    return both.select(F.col("_id").alias(id_col), "keep_id", "group_size",
                       F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.col("_digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows that repeat an id and its text, one.

    Only ids meet the texts again, and repeats are found where they meet: the texts are shuffled once. Rows with a
    null id are told apart by nothing; if a text stands under null ids only, all of them stay.
    """
    kept = cut_lineage(exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id")).distinct())
    known = docs.filter(docs[id_col].isNotNull())
    known = known.join(kept, known[id_col] == kept["_kept_id"], "left_semi")
    nth = "_nth"
    while nth in docs.columns:
        nth += "_"
    again = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0))
    known = known.withColumn(nth, F.row_number().over(again)).filter(F.col(nth) == 1).drop(nth)
    none = F.broadcast(kept.filter("_kept_id IS NULL"))  # one row at most
    return known.unionByName(docs.filter(docs[id_col].isNull()).join(none, F.lit(True), "left_semi"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
