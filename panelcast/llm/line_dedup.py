"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

1. One scan of the texts explodes the long lines to (id, position, 128-bit hash) rows, written
   by batch: ranges of ids, the largest first.
2. The runs: tables bucketed and sorted by hash, one row per hash with the number of documents
   found so far and the largest id that holds it. Each batch, counted per hash, is merge-joined
   against the runs; what is settled there (found in enough documents, and since the largest
   ids come first, by its final keeper) is anti-joined away, the rest becomes a run of its own.
   Whenever two runs stand on the same level they are merged into one on the next level, so
   there are never more runs than the logarithm of the batches. Bucketing keeps all these
   joins without a shuffle of the runs.
3. The hashes of enough documents are joined back to the lines' positions: the most frequent
   ones, of which there are fewer than `winners` by their share of all counts, map-side, the
   others by an ordinary shuffle.
4. The texts meet only their own dropped positions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import remove_folder, scratch_folder, shuffle_width, table
from panelcast.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
KEY = ["_h1", "_h2"]


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(_id, _row, _at, _h1, _h2) of each line whose key has at least min_chars code points.

    _row tells rows apart that repeat an id with other texts.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_row"),
                       F.posexplode(text_lines(F.col(text_col))).alias("_at", "_line"))
    rows = rows.withColumn("_line", F.btrim("_line", F.lit(BLANK))).filter(F.char_length("_line") >= min_chars)
    key = F.translate("_line", UPPER, LOWER)
    return rows.select("_id", "_row", "_at", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"))


@dataclass
class LineRuns:
    """Levelled runs of (_h1, _h2, _docs, _keeper), sorted by hash.

    The ids of each batch must be smaller than those of the batches before it.
    """
    spark: SparkSession
    folder: str
    settled: int
    runs: list[tuple[str, int]] = field(default_factory=list)  # (table, level), oldest first
    made: list[str] = field(default_factory=list)

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.format("parquet").bucketBy(shuffle_width(self.spark), *KEY).sortBy(*KEY)
         .option("path", f"{self.folder}/{name}").saveAsTable(name))
        self.made.append(name)
        self.runs.append((name, level))

    @staticmethod
    def _merge(one: DataFrame, other: DataFrame) -> DataFrame:
        other = other.select(*KEY, F.col("_docs").alias("_docs2"), F.col("_keeper").alias("_keeper2"))
        none = F.lit(0).cast("long")
        return one.join(other.hint("merge"), KEY, "full").select(
            *KEY, (F.coalesce("_docs", none) + F.coalesce("_docs2", none)).alias("_docs"),
            F.greatest("_keeper", "_keeper2").alias("_keeper"))

    def add(self, lines: DataFrame) -> None:
        """Count a batch of (_id, _h1, _h2), leave out what is settled, add the rest as a run; compact."""
        rows = lines.groupBy(*KEY).agg(F.count_distinct("_id").alias("_docs"), F.max("_id").alias("_keeper"))
        for name, _ in self.runs:
            done = self.spark.table(name).filter(F.col("_docs") >= self.settled).select(*KEY)
            rows = rows.join(done.hint("merge"), KEY, "left_anti")
        self._write(rows, 0)
        while len(self.runs) > 1 and self.runs[-1][1] == self.runs[-2][1]:
            (first, level), (second, _) = self.runs[-2:]
            del self.runs[-2:]
            self._write(self._merge(self.spark.table(first), self.spark.table(second)), level + 1)

    def repeated(self) -> DataFrame:
        """(_h1, _h2, _docs, _keeper) of the settled hashes of all runs."""
        rows = None
        for name, _ in reversed(self.runs):
            rows = self.spark.table(name) if rows is None else self._merge(self.spark.table(name), rows)
        return rows.filter(F.col("_docs") >= self.settled)

    def close(self) -> None:
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int,
                      batches: int, winners: int) -> DataFrame:
    """(_id, _row, _gone): positions of the lines that go, for texts that lose any."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "line-dedup")
    bounds = docs.agg(F.percentile_approx(F.col(id_col), [(k + 1) / batches for k in range(batches - 1)])
                      if batches > 1 else F.array()).first()[0] or []
    later = sum((F.col("_id") <= b).cast("int") for b in sorted(set(bounds))) + F.lit(0)
    (long_lines(docs, id_col, text_col, min_chars).withColumn("_batch", F.coalesce(later, F.lit(-1)))
     .write.partitionBy("_batch").parquet(f"{folder}/lines"))
    # the schema is given, since an empty table leaves no file to read it from
    lines = spark.read.schema("_id long, _row long, _at int, _h1 long, _h2 long, _batch int").parquet(f"{folder}/lines")
    runs = LineRuns(spark, folder, min_docs)
    for k in range(len(set(bounds)) + 1):
        runs.add(lines.filter(F.col("_batch") == k).select("_id", *KEY))
    found = cut_lineage(runs.repeated())
    total = found.agg(F.coalesce(F.sum("_docs"), F.lit(0))).first()[0]
    heavy = F.broadcast(found.filter(F.col("_docs") * winners > total))
    light = found.filter(F.col("_docs") * winners <= total)
    hits = lines.join(heavy, KEY).unionByName(lines.join(heavy.select(*KEY), KEY, "left_anti").join(light, KEY))
    gone = cut_lineage(hits.filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
                       .groupBy("_id", "_row").agg(F.collect_set("_at").alias("_gone")))
    runs.close()
    remove_folder(spark, folder)
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
               min_docs: int = 5, batches: int = 4, winners: int = 2048) -> DataFrame:
    """One row per input row: <id_col>, n_lines, n_dropped, text (the kept lines joined by \\n).

    Null and empty texts are one empty line. Documents are counted by distinct non-null id;
    lines of rows with a null id count for nothing and go where the others hold them often
    enough. All rows that repeat the largest id keep their lines, a line repeated inside that
    document too. An empty table gives an empty result. Other columns are ignored.
    `batches` and `winners` steer the work, not the result.
    """
    gone = dropped_positions(docs, id_col, text_col, min_chars, min_docs, batches, winners)
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))
    both = rows.join(gone, rows["_doc"].eqNullSafe(gone["_id"]) & (rows["_key"] == gone["_row"]), "left")
    lines = text_lines(F.col("_text"))
    both = both.select("_doc", lines.alias("_lines"), "_gone")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_lines")).otherwise(
        F.transform(places, lambda i: F.get("_lines", i)))
    return both.select(F.col("_doc").alias(id_col), F.size("_lines").cast("long").alias("n_lines"),
                       F.coalesce(F.array_size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.array_join(kept, "\n").alias("text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
  SELECT r, doc_id, i, ls[i] AS line,
         translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM k.keeper AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
