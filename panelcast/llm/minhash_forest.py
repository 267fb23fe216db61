"""MinHash near-dedup with an LSH forest.

1. One pass over the texts: word shingles, their number, a digest of the whole set, and a
   signature of TREES x LABELS minima. Documents with equal sets form a class; one
   representative (the smallest id) goes on, so copies are never paired.
2. The forest: tree t orders the representatives by the signature rotated to start at label
   t * LABELS. Only documents that share the first LABELS labels are candidates, and of
   those the neighbours in the order, which are the ones with the longest common prefix.
   In thin regions the neighbours are all of the region; in dense ones they are the documents
   that agree to a greater depth: the depth adapts by itself, the number of candidates stays
   linear. The orders are range partitioned, so a dense region spans as many tasks as it needs.
3. Candidates are confirmed on the full shingle sets, which are computed again for candidate
   documents only.
4. Two rounds: a few trees with the direct neighbour join the large groups; components are
   formed; then all trees with a longer reach, but only pairs of different components. Links
   inside a component cannot change the result, so the second round is short where the data
   are dense, and looks hard at whatever is not linked yet.
5. A last round completes what a reach cannot: the documents of regions with more rows than the
   reach covers and more than one component go through `rare_links`, which splits sets into what
   the crowd shares and what is their own and finds all their links without testing all pairs.

Two documents of similarity 0.75 share the first 4 labels of at least one of 32 trees with
probability 1 - 5e-6, and pass the test of the labels behind them with 1 - 3e-5; more
similar ones still more surely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import rows_in_slices, shuffle_width, table
from panelcast.llm.components import components
from panelcast.llm.rare_links import OFTEN, rare_links
from panelcast.session import cut_lineage

WIDTH, TREES, LABELS = 5, 32, 4
SIGNATURE = TREES * LABELS
#: Trees and reach of each round.
ROUNDS = ((6, 1), (TREES, 8))
ALIKE = 5
#: A class or set with more than 1 / HEAVY of all rows is joined by broadcast: HEAVY rows at most.
HEAVY = 2048
FILTER_BITS = 1 << 23

_rng = np.random.default_rng(20240501)
_STEP = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(0, 2**31, SIGNATURE, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 2**32, SIGNATURE, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Fewer than WIDTH
    words make one shingle of the whole sequence; no words, no shingle.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(WIDTH, len(words))
    s = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        s += h[i:len(words) - n + 1 + i] * _STEP[i]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0x9E3779B97F4A7C15)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), SIGNATURE) minima; the sets must not be empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), SIGNATURE), np.uint32)
    for j in range(SIGNATURE):
        out[:, j] = np.minimum.reduceat((x ^ _XOR[j]) * _ODD[j], starts)
    return out


def _sketch(batches):
    for part in rows_in_slices(batches):
        ids, texts = part.column(0), part.column(1).cast(pa.binary())
        n, digest, sigs, pending, at = [], [], [None] * part.num_rows, [], []

        def flush():
            if pending:
                for k, row in zip(at, signatures(pending), strict=True):
                    sigs[k] = row.astype(">u4").tobytes()
                pending.clear()
                at.clear()

        for k in range(part.num_rows):
            s = shingle_set(texts[k].as_py())
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            if len(s):
                pending.append(s)
                at.append(k)
                if sum(map(len, pending[-64:])) > 65536 or len(pending) >= 64:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                          pa.array(sigs, pa.binary())], ["_id", "_n", "_set", "_sig"])


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_sketch, "_id long, _n long, _set binary, _sig binary")


def _orders(trees: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n = batch.column(0), batch.column(1)
            comp = batch.column(3)
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, SIGNATURE).astype(np.uint64)
            for t in range(trees):
                region = np.full(len(sig), t + 1, np.uint64)
                for i in range(LABELS):
                    region = (region ^ sig[:, t * LABELS + i]) * np.uint64(0x9E3779B97F4A7C15)
                    region ^= region >> np.uint64(31)
                deeper = np.zeros(len(sig), np.uint64)
                for i in range(8):  # a byte of each of the next labels orders the region
                    deeper = (deeper << np.uint64(8)) | (sig[:, (t * LABELS + LABELS + i) % SIGNATURE] >> np.uint64(24))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region.view(np.int64)), pa.array(deeper.view(np.int64)), node, n, comp],
                    ["_region", "_deeper", "_node", "_n", "_comp"])
    return run


def _neighbours(reach: int):
    """Pairs at most `reach` apart in the order, in one region, of different components.

    The sizes must allow the similarity, and of the 8 labels after the shared ones ALIKE must
    agree: at similarity 0.75 they do with probability 0.886 in each tree the pair shares.
    """
    def run(batches):
        kept = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            rows = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            old = 0 if kept is None else len(kept[0])
            region, deeper, node, n, comp = rows
            pairs = []
            for k in range(1, reach + 1):
                if len(region) <= k:
                    break
                i = np.arange(max(0, old - k), len(region) - k)
                j = i + k
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                good = (region[i] == region[j]) & (comp[i] != comp[j]) & (100 * small >= 75 * large)
                i, j = i[good], j[good]
                good = ((deeper[i] ^ deeper[j]).view(np.uint8).reshape(-1, 8) == 0).sum(1) >= ALIKE
                i, j = i[good], j[good]
                pairs.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))
            kept = [x[-reach:] for x in rows]
            found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
    return run


def candidates(classes: DataFrame, trees: int, reach: int) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of classes (_rep, _n, _sig, _comp)."""
    rows = classes.select("_rep", "_n", "_sig", "_comp").mapInArrow(
        _orders(trees), "_region long, _deeper long, _node long, _n long, _comp long")
    width = shuffle_width(classes.sparkSession)
    rows = (rows.repartitionByRange(width, "_region", "_deeper", "_node")
            .sortWithinPartitions("_region", "_deeper", "_node"))
    return rows.mapInArrow(_neighbours(reach), "a long, b long").distinct()


def crowded(classes: DataFrame, trees: int, reach: int) -> DataFrame:
    """(_id) of the classes in regions of more rows than the reach covers, and of more than one component."""
    rows = classes.select("_rep", "_n", "_sig", "_comp").mapInArrow(
        _orders(trees), "_region long, _deeper long, _node long, _n long, _comp long").select("_region", "_node", "_comp")
    parts = rows.groupBy("_region").agg(F.count(F.lit(1)).alias("_all"), F.min("_comp").alias("_a"), F.max("_comp").alias("_b"))
    parts = parts.filter((F.col("_all") > reach + 1) & (F.col("_a") != F.col("_b")))
    return rows.join(parts.select("_region"), "_region", "left_semi").select(F.col("_node").alias("_id")).distinct()


def _sets_of(wanted, listed: bool = False):
    """Shingle sets of the rows whose id may be wanted, as bytes or as lists of longs, and their digests."""
    def run(batches):
        bits = wanted.value
        for part in rows_in_slices(batches):
            ids, spot = part.column(0), part.column(2).to_numpy(zero_copy_only=False)
            take = np.flatnonzero(bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            texts = part.column(1).cast(pa.binary())
            sets = [shingle_set(texts[int(k)].as_py()) for k in take]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            if listed:
                sets = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            else:
                sets = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), sets, digests], ["_id", "_s", "_set"])
    return run


def _spot(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame) -> np.ndarray:
    """One hash bitmap of FILTER_BITS bits over all ids: a prefilter of fixed size.

    It may let other rows pass, never stops one; the join behind it decides.
    """
    block = 8 * 4096  # bits in one bitmap of bitmap_construct_agg
    bitmaps = (ids.select(_spot("_id").alias("_spot"))
               .groupBy(F.floor(F.col("_spot") / block).alias("_k"))
               .agg(F.bitmap_construct_agg(F.col("_spot") % block).alias("_bits")))
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bitmaps.collect():  # FILTER_BITS / 8 bytes in all
        whole[row["_k"] * 4096:(row["_k"] + 1) * 4096] = np.frombuffer(row["_bits"], np.uint8)
    return whole


def _confirm(batches):
    for batch in batches:
        a, b = batch.column(0), batch.column(1)
        x, y = batch.column(2), batch.column(3)
        good = []
        for k in range(batch.num_rows):
            s, t = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (x, y))
            if len(s) > len(t):
                s, t = t, s
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[at] == s).sum())
            good.append(100 * both >= 75 * (len(s) + len(t) - both))
        keep = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def strays(rows: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(_id, _set) of the rows under a representative's id whose set stands under another id; None where there are none.

    There are some only where rows repeat an id with other texts.
    """
    led = classes.select(F.col("_rep").alias("_id"), "_set")
    found = cut_lineage(rows.select("_id", "_set").join(led.select("_id"), "_id", "left_semi")
                        .join(led, ["_id", "_set"], "left_anti").distinct())
    return found if found.take(1) else None


def sets_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, listed: bool = False,
            without: DataFrame | None = None) -> DataFrame:
    """(_id, _s): shingle sets of the rows with one of the ids, and of a few others, but for those of `without`."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).filter("_id IS NOT NULL")
    sets = rows.withColumn("_spot", _spot("_id")).mapInArrow(
        _sets_of(bits, listed), f"_id long, _s {'array<long>' if listed else 'binary'}, _set binary")
    if without is not None:
        sets = sets.join(without, ["_id", "_set"], "left_anti")
    return sets.select("_id", "_s")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, without: DataFrame | None = None) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= 75 * union."""
    ends = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id")))
    sets = sets_of(ends, docs, id_col, text_col, without=without)
    both = (pairs.join(sets.select(F.col("_id").alias("a"), F.col("_s").alias("_x")), "a")
            .join(sets.select(F.col("_id").alias("b"), F.col("_s").alias("_y")), "b"))
    return both.select("a", "b", "_x", "_y").mapInArrow(_confirm, "a long, b long").distinct()


def crowd_links(joined: DataFrame, docs: DataFrame, id_col: str, text_col: str, often: int,
                without: DataFrame | None = None) -> DataFrame:
    """Links between components in the crowded regions of the last round's forest."""
    trees, reach = ROUNDS[-1]
    ids = cut_lineage(crowded(joined, trees, reach))
    comps = joined.groupBy(F.col("_rep").alias("_id")).agg(F.min("_comp").alias("_comp")).join(ids, "_id", "left_semi")
    items = sets_of(ids, docs, id_col, text_col, listed=True, without=without).join(comps, "_id")
    items = items.filter(F.size("_s") > 0)
    return rare_links(items.select("_id", F.size("_s").cast("long").alias("_n"), "_comp", F.col("_s").alias("_t")), often)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", often: int = OFTEN) -> DataFrame:
    """One row per input row: <id_col>, n_shingles, component_id, kept.

    Null, empty and wordless texts have no shingles and are linked with nothing: they are
    their own component and kept. Rows with a null id take part in no link; their
    component_id is null and they are kept. Rows of equal sets stand under their smallest
    id; where rows repeat an id with other texts, sets under the same id count as linked. Ties
    cannot occur, since the smallest id decides. An empty table gives an empty result; other
    columns, whatever their names, are ignored. `often` steers the work in crowded regions, not
    the result.
    """
    rows = cut_lineage(sketches(docs, id_col, text_col))
    full = rows.filter("_n > 0 AND _id IS NOT NULL")
    classes = full.groupBy("_set").agg(F.min(F.struct("_id", "_n", "_sig")).alias("_r"),
                                       F.count(F.lit(1)).alias("_size"))
    classes = cut_lineage(classes.select("_set", "_size", F.col("_r._id").alias("_rep"), F.col("_r._n").alias("_n"),
                                         F.col("_r._sig").alias("_sig")))
    def with_components(found):
        if found is None:
            return classes.withColumn("_comp", F.col("_rep"))
        return (classes.join(found, classes["_rep"] == found["node"], "left")
                .withColumn("_comp", F.coalesce("component", "_rep")).drop("node", "component"))

    def joined_by(links, found):
        if found is not None:
            links = links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return cut_lineage(components(links))
    found, without = None, strays(full, classes)
    for trees, reach in ROUNDS:
        pairs = cut_lineage(candidates(with_components(found), trees, reach))
        found = joined_by(confirmed(pairs, docs, id_col, text_col, without), found)
    found = joined_by(crowd_links(cut_lineage(with_components(found)), docs, id_col, text_col, often, without), found)

    verdict = (classes.select("_set", "_size", "_rep").join(found, F.col("_rep") == F.col("node"), "left")
               .select("_set", "_size", F.coalesce("component", "_rep").alias("component_id")))
    # a representative's id may stand for several classes where ids repeat; all have its component
    verdict = cut_lineage(verdict)
    total = verdict.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    heavy = verdict.filter(F.col("_size") * HEAVY > total).drop("_size")
    light = verdict.filter(F.col("_size") * HEAVY <= total).drop("_size")
    ids = rows.select("_id", "_n", "_set")
    sets = ids.filter("_n > 0 AND _id IS NOT NULL")
    out = sets.join(F.broadcast(heavy), "_set").unionByName(
        sets.join(F.broadcast(heavy.select("_set")), "_set", "left_anti").join(light, "_set"))
    rest = ids.filter("_n = 0 OR _id IS NULL").withColumn("component_id", F.col("_id"))
    out = out.unionByName(rest)
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id",
                      F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one document of each group, with all columns."""
    kept = near_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, counted exactly; components by a recursive walk over the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h
  FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 75 * (m.n + o.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, reach) AS (
  SELECT a, a FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""
