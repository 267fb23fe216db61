"""Mixing sources to target weights by a low-discrepancy schedule.

`slots` points of the golden-ratio sequence are mapped through the cumulative target
shares, so that every prefix of the schedule holds the sources in nearly the target
proportions. A source too small for any of the points gets one slot behind them, so every
source with a target has a block. Slots are ranked per source; rank r of a source takes the r-th of its
equal-token blocks: the source's documents in a hash order, read round and round, cut into
as many equal blocks as the source has slots. A document's words in the mix are the sum of
its overlaps with the blocks that the schedule takes.

Running totals never put a source into one task: the hash order is cut into buckets, bucket
totals (a small table) give the offsets, and windows run inside (source, bucket).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import WORD, table
from panelcast.session import cut_lineage

GOLDEN = 0.6180339887498949
WEIGHTS = (5, 2, 1)
CELLS = 1024
#: Words of a block of the schedule, about; slots of a schedule at least.
BLOCK_WORDS, LEAST_SLOTS = 65536, 4096


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """(_id, _source, _size, _hash): words of the whole text and the shuffling key."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)).cast("binary"))
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                       size.alias("_size"), key.alias("_hash"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, times: int = 3) -> DataFrame:
    """(_source, _src, source_size, target): one row per source.

    Sources by code point, null last, weigh `weights` in turn. A target is the source's
    share of all words, stopped at `times` its size; the excess goes to the others by
    weight. In the order of size / weight the stopped sources form a prefix: source k stops
    if its limit is at most its weight times what is left per weight unit.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    # one row per source from here on: the windows without a key run over that table
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    per = per.withColumn("_src", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(cycle, (F.col("_src") % len(weights) + 1).cast("int")))
    limit = F.lit(times) * F.col("source_size")
    early = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_src")).rowsBetween(
        Window.unboundedPreceding, -1)
    late = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("_src")).rowsBetween(
        Window.currentRow, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum(limit).over(early), F.lit(0))
    per = per.withColumn("_level", left / F.sum("_w").over(late))
    per = per.withColumn("_stop", limit <= F.col("_w") * F.col("_level"))
    # past the first source that does not stop the levels only fall: its own is the largest
    level = F.max(F.when(~F.col("_stop"), F.col("_level"))).over(everyone)
    target = F.when(F.col("_stop"), limit.cast("double")).otherwise(F.col("_w") * level)
    return per.select("_source", "_src", "source_size", target.alias("target"))


def schedule(spark: SparkSession, goals: DataFrame, slots: int) -> DataFrame:
    """(slot, _src, rank, n_slots): the order in which sources' blocks enter the mix.

    The points meet the sources' intervals through a grid of cells (an equality join of
    at most slots rows with sources + CELLS rows). Sources whose interval holds no point
    follow in slots, slots + 1, ..., one each, in the order of _src.
    """
    upto = Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(Window.partitionBy())
    spans = goals.select("_src", "target", F.sum("target").over(upto).alias("_upto"), total.alias("_total"))
    spans = spans.filter("target > 0").select(
        "_src", ((F.col("_upto") - F.col("target")) / F.col("_total")).alias("_lo"),
        F.when(F.col("_upto") >= F.col("_total"), F.lit(1.0)).otherwise(F.col("_upto") / F.col("_total")).alias("_hi"))
    # the next source begins where this one ends, to the last bit
    spans = spans.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("_src")), F.lit(0.0)))
    cells = spans.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_lo") * CELLS), F.floor(F.col("_hi") * CELLS))))
    point = F.expr(f"((id + 1) * {GOLDEN}D) % 1D")
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS))
    taken = (points.join(cells, "_cell").filter("_u >= _lo AND _u < _hi").select("slot", "_src"))
    # rank inside stretches of slots, offset by the stretches before: no source in one task
    taken = taken.withColumn("_stretch", F.floor(F.col("slot") / 4096))
    counts = taken.groupBy("_src", "_stretch").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_src").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_src", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                           F.sum("_n").over(Window.partitionBy("_src")).alias("n_slots"))
    inside = Window.partitionBy("_src", "_stretch").orderBy("slot")
    ranked = taken.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = (ranked.join(counts, ["_src", "_stretch"])
              .select("slot", "_src", (F.col("_off") + F.col("_rank")).alias("rank"), "n_slots"))
    missed = spans.select("_src").join(counts.select("_src").distinct(), "_src", "left_anti")
    missed = missed.select((F.row_number().over(Window.orderBy("_src")) + (slots - 1)).cast("long").alias("slot"), "_src",
                           F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("n_slots"))
    return ranked.unionByName(missed)


def slot_count(words: int, block_words: int = BLOCK_WORDS) -> int:
    """Slots of a schedule for so many words: blocks of about block_words, LEAST_SLOTS at least."""
    return max(LEAST_SLOTS, -(-words // block_words))


def placements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple = WEIGHTS, times: int = 3, slots: int | None = None, seed: str = "mix",
               digits: int = 3) -> DataFrame:
    """`mix` with a column rounds: (round, slot) of each time that a row is read, by the slot of its first block."""
    spark = docs.sparkSession
    rows = cut_lineage(sized(docs, id_col, text_col, source_col, seed))
    goals = cut_lineage(targets(rows, weights, times))
    if slots is None:
        slots = slot_count(goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    plan = cut_lineage(schedule(spark, goals, slots))

    rows = rows.withColumn("_bucket", F.substring("_hash", 1, digits))
    totals = rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    offsets = offsets.join(goals, offsets["_source"].eqNullSafe(goals["_source"])).select(
        offsets["_source"].alias("_s"), F.col("_bucket").alias("_b"), "_off", "_src", "source_size", "target")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", F.col("_id").asc_nulls_last(), "_size")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (rows.withColumn("_row", F.row_number().over(inside))
              .withColumn("_in", F.sum("_size").over(running) - F.col("_size")))
    placed = placed.join(offsets, placed["_source"].eqNullSafe(offsets["_s"]) & (F.col("_bucket") == F.col("_b")))
    placed = placed.withColumn("_start", F.col("_off") + F.col("_in"))

    # a document's place in each round of its source, cut off at the target
    goal = F.floor("target")
    ends = plan.groupBy("_src").agg(F.max("n_slots").alias("_n"))
    placed = placed.join(ends, "_src", "left")
    rounds = F.when((F.col("_size") > 0) & F.col("_n").isNotNull() & (goal > 0),
                    F.filter(F.sequence(F.lit(0), F.lit(times - 1)),
                             lambda e: F.col("_start") + e * F.col("source_size") < goal))
    pieces = placed.withColumn("_e", F.explode_outer(rounds))
    a = F.col("_start") + F.col("_e") * F.col("source_size")
    pieces = pieces.withColumn("_a", a).withColumn("_z", F.least(a + F.col("_size"), goal))

    # words times slots do not fit a long at every size
    first, last = (F.expr(f"(cast({x} as decimal(19, 0)) * cast(_n as decimal(19, 0)) - 1) div floor(target)") for x in ("_a + 1", "_z"))
    pieces = pieces.withColumn("rank", F.explode_outer(F.when(F.col("_e").isNotNull(), F.sequence(first, last))))
    blocks = plan.select("_src", "rank", "slot")
    joined = pieces.join(blocks, ["_src", "rank"], "left")
    begins, finishes = (F.expr(f"cast({r} as decimal(19, 0)) * cast(floor(target) as decimal(19, 0)) div _n") for r in ("rank", "rank + 1"))
    overlap = F.when(F.col("slot").isNotNull(),
                     F.greatest(F.lit(0), F.least(F.col("_z"), finishes) - F.greatest(F.col("_a"), begins)))
    keys = ["_src", "_bucket", "_row", "_id", "_size", "source_size", "target"]
    each = joined.groupBy(*keys, "_e").agg(F.sum(overlap).alias("_taken"), F.min("slot").alias("_slot"), F.count("slot").alias("_k"))
    read = F.struct(F.col("_e").alias("round"), F.col("_slot").alias("slot"))
    return (each.groupBy(*keys).agg(
                F.coalesce(F.sum("_taken"), F.lit(0)).cast("long").alias("taken"), F.min("_slot").alias("first_slot"),
                F.sum("_k").alias("n_blocks"), F.array_sort(F.collect_list(F.when(F.col("_slot").isNotNull(), read))).alias("rounds"))
            .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "taken",
                    "first_slot", "n_blocks", "rounds"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per input row: <id_col>, size, source_size, target, taken, first_slot, n_blocks.

    first_slot is the place in the schedule of the first block that takes words of the row (null: none does),
    n_blocks the number of blocks that do. Size is the number of words of the whole text; null and empty texts
    have size 0 and are never taken. A null source is a source of its own, the last. Rows that share an id are
    ordered by size and count each for themselves. If all texts are empty, targets and
    taken are 0. A source's taken words are its target rounded down, however small its share. A row is taken at most `times`
    times. The number of slots follows from the number of words. Reruns give the same rows. An empty table gives an
    empty result; other columns are ignored. 16^digits buckets cut the running totals of a source.
    """
    return placements(docs, id_col, text_col, source_col, **how).drop("rounds")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """`docs` as the mix takes them, in the order of the schedule: each row as often as its words are taken.

    The copy of a round stands at the slot of its first block. Only the document at the end of a source's last
    round is taken in part; it counts as a whole if at least half of it is taken. Documents taken 0 times go.
    """
    found = placements(docs, id_col, **how).filter("taken > 0")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    found = found.select(F.col(id_col).alias("_mix_id"), F.slice("rounds", F.lit(1), copies)["slot"].alias("_mix_slots"))
    # repeated ids: the largest count holds, so that a row is not multiplied by its twins
    found = found.filter(F.size("_mix_slots") > 0).groupBy("_mix_id").agg(
        F.max(F.struct(F.size("_mix_slots"), F.col("_mix_slots")))["_mix_slots"].alias("_mix_slots"))
    joined = docs.join(found, docs[id_col].eqNullSafe(found["_mix_id"]))
    slot = "_mix_slot"
    while slot in docs.columns:
        slot += "_"
    rows = joined.select(*[docs[c] for c in docs.columns], F.explode(found["_mix_slots"]).alias(slot))
    return rows.orderBy(slot, id_col).drop(slot)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same mix in closed form: a document's overlap with its source's first floor(target) words; the schedule point by point.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix') AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s),
w AS (SELECT *, CASE src % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
               ORDER BY source_size / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (ORDER BY source_size / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w),
t AS (
  SELECT source, src, source_size,
         CASE WHEN 3 * source_size <= w * lev THEN (3 * source_size)::DOUBLE
              ELSE w * max(CASE WHEN 3 * source_size > w * lev THEN lev END) OVER () END AS target
  FROM l),
sc AS (SELECT greatest(4096, (sum(source_size) + 65535) // 65536) AS slots FROM t),
pt AS (SELECT k AS slot, ((k + 1) * 0.6180339887498949::DOUBLE) % 1 AS u FROM (SELECT unnest(range(0, slots::BIGINT)) AS k FROM sc)),
sp AS (
  SELECT src, CASE WHEN upto >= total THEN 1.0 ELSE upto / total END AS hi
  FROM (SELECT src, target, sum(target) OVER (ORDER BY src) AS upto, sum(target) OVER () AS total FROM t) WHERE target > 0),
iv AS (SELECT src, coalesce(lag(hi) OVER (ORDER BY src), 0.0) AS lo, hi FROM sp),
hit AS (SELECT src, slot FROM pt JOIN iv ON u >= lo AND u < hi),
ev AS (
  SELECT src, slot FROM hit UNION ALL
  SELECT src, slots + row_number() OVER (ORDER BY src) - 1 FROM iv, sc WHERE src NOT IN (SELECT src FROM hit)),
pl AS (SELECT src, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rank, count(*) OVER (PARTITION BY src) AS k FROM ev),
p AS (
  SELECT d.doc_id, d.size, t.src, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id NULLS LAST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT p.*, floor(target)::HUGEINT AS goal, k FROM p LEFT JOIN (SELECT DISTINCT src, k FROM pl) USING (src)),
b AS (
  SELECT *, CASE WHEN size > 0 AND a < goal THEN ((a + 1) * k - 1) // goal END AS r0,
         list_sum(list_transform([0, 1, 2], lambda e: CASE WHEN size > 0 AND a + e * source_size < goal THEN
           (least(a + e * source_size + size, goal) * k - 1) // goal - ((a + e * source_size + 1) * k - 1) // goal + 1 ELSE 0 END)) AS nb
  FROM q)
SELECT doc_id, size::BIGINT AS size, b.source_size, target,
       (greatest(0, least(a + size, floor(target)) - least(a, floor(target)))
        + greatest(0, least(a + source_size + size, floor(target)) - least(a + source_size, floor(target)))
        + greatest(0, least(a + 2 * source_size + size, floor(target)) - least(a + 2 * source_size, floor(target)))
       )::BIGINT AS taken, pl.slot::BIGINT AS first_slot, coalesce(nb, 0)::BIGINT AS n_blocks
FROM b LEFT JOIN pl ON pl.src = b.src AND pl.rank = b.r0
"""
