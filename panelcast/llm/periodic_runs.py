"""Periodic runs of words by a scale-tiled distribution.

A run of period q and length l is a stretch of l - q places i with word[i] = word[i + q]. Periods
are taken by octaves: for q in [b, 2b), b a power of two, every stretch that counts has at least
b places, so it covers an anchor, a place divisible by b.

1. Documents are exploded into tiles: all octaves of a short document are one tile; a longer one
   has overlapping tiles of TILE anchors' places for the small octaves, and tiles of REACH anchors
   for each octave above. Tiles of long documents are dealt over all tasks.
2. A tile is solved by itself: at each anchor two boundary Z-functions, forward (how far the words
   from the anchor on agree with those a period later) and backward, each up to b places. Their
   values are read off names of the windows of 1, 2, 4, ... words, for all anchors, periods and tiles
   of a batch at once. Every octave costs time in proportion to its words.
3. The pieces go by document and period to one place, where touching pieces become whole
   stretches again. Of stretches with the same ends the smallest period is the run's own; the
   others are its multiples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm.common import SPACE, rows_in_slices, shuffle_width, table
from panelcast.llm.minhash_forest import FILTER_BITS, id_filter
from panelcast.session import cut_lineage

#: Words of a tile of the small octaves, octaves in it (2 ** 10 = TILE / 16), anchors of a tile of a large one.
TILE, SMALL, REACH = 1 << 14, 10, 8
#: Words that are solved together.
BATCH = 1 << 18
#: Every run of at least 12 words repeats a stretch of at least 6 words.
STRETCH = 6

PIECES = "_id long, _row long, _n long, _period long, _from long, _to long"
TILES = "_id long, _row long, _n long, _low int, _high int, _first long, _last long, _base long, _words binary"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def word_numbers(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def tiles_of(n: int, tile: int = TILE, small: int = SMALL) -> list[tuple[int, int, int, int, int, int]]:
    """(lowest octave, highest octave, first anchor place, end of the anchor places, first word, end of the words)."""
    top = n.bit_length() - 2  # the largest octave with 2 * 2 ** top <= n
    if top < 0:
        return []
    if n <= tile:
        return [(0, top, 0, n, 0, n)]
    out = []
    for low, high in [(0, min(small, top)), *((k, k) for k in range(small + 1, top + 1))]:
        b = 1 << high
        step = max(tile, b) if low == 0 else REACH * b
        for first in range(0, n, step):
            last = min(n, first + step)
            out.append((low, high, first, last, max(0, first - b), min(n, last + 3 * b)))
    return out


def _blend(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = (x ^ (x >> np.uint64(29))) * _MIX + (y ^ (y >> np.uint64(31))) * _ODD
    return (z ^ (z >> np.uint64(32))) * _MIX


def window_names(words: np.ndarray, levels: int) -> list[np.ndarray]:
    """names[j][i]: a 64-bit name of the 2 ** j words from i on; windows beyond the end have names of their own."""
    names = [_blend(words.astype(np.uint64) + _ODD, words.astype(np.uint64))]
    beyond = (np.arange(len(words), dtype=np.uint64) + np.uint64(1 << 40)) * _MIX
    for j in range(levels):
        shifted = beyond.copy()
        if 1 << j < len(words):
            shifted[:-(1 << j)] = names[j][1 << j:]
        names.append(_blend(names[j], shifted))
    return names


def z_forward(names, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """How many words from a on agree with those from b on, 2 ** k at most."""
    f = np.where(names[k][a] == names[k][b], 1 << k, 0)
    left = np.flatnonzero(f == 0)
    at, to = a[left], b[left]
    for j in range(k - 1, -1, -1):
        step = (names[j][at] == names[j][to]).astype(np.int64) << j
        at, to = at + step, to + step
    f[left] = at - a[left]
    return f


def z_backward(names, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """How many words before a agree with those before b, 2 ** k at most."""
    def agree(j, at, to):
        room = at >= 1 << j
        x, y = np.where(room, at - (1 << j), 0), np.where(room, to - (1 << j), 1)
        return room & (names[j][x] == names[j][y])
    g = np.where(agree(k, a, b), 1 << k, 0)
    left = np.flatnonzero(g == 0)
    at, to = a[left], b[left]
    for j in range(k - 1, -1, -1):
        step = agree(j, at, to).astype(np.int64) << j
        at, to = at - step, to - step
    g[left] = a[left] - at
    return g


def _joined(tiles):
    """The tiles' words in one array, each tile closed by a word of its own; where each tile starts."""
    sizes = np.array([len(t[-1]) + 1 for t in tiles])
    starts = 1 + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    words = np.empty(1 + sizes.sum(), np.int64)
    words[0] = -1
    for at, size, t, k in zip(starts, sizes, tiles, range(len(tiles)), strict=True):
        words[at:at + size - 1] = t[-1]
        words[at + size - 1] = -2 - k
    return words, starts, sizes


def repetitive(tiles) -> list:
    """The tiles of parts of documents, and the whole documents that repeat a window of STRETCH words.

    A document without such a window holds no run; a part may hold a shorter piece of one.
    """
    words, starts, sizes = _joined(tiles)
    names = window_names(words, 2)[2]
    whole = names.copy()
    whole[:-2] = _blend(names[:-2], names[2:])
    owner = np.repeat(np.arange(len(tiles)), sizes)
    mine = _blend(whole[1:], owner.astype(np.uint64))
    order = np.argsort(mine)
    same = np.flatnonzero(mine[order][1:] == mine[order][:-1])
    again = set(owner[order[same]].tolist())
    return [t for k, t in enumerate(tiles) if not t[5] or k in again]


def solve(tiles, min_words: int):
    """Pieces (tile number, period, from, to) in document places: from <= i < to with word[i] = word[i + period].

    A tile is (low, high, first, last, base, whole, words): its octaves, its anchors' places, the place of its
    first word, whether it is the whole document. Pieces too short for a run are left out unless
    they reach as far as the tile sees.
    """
    words, starts, sizes = _joined(tiles)
    low, high, first, last, base = (np.array([t[c] for t in tiles], np.int64) for c in range(5))
    whole = np.array([t[5] for t in tiles])
    names = window_names(words, int(high.max()) + 1)
    counts = last - first
    tile = np.repeat(np.arange(len(tiles)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[tile]
    spot = place - base[tile] + starts[tile]
    end = (starts + sizes - 1)[tile]
    found = []
    for k in range(int(low.min()), int(high.max()) + 1):
        b = 1 << k
        use = (low[tile] <= k) & (k <= high[tile]) & (spot + b < end)
        t, x, i = tile[use], spot[use], place[use]
        a, q = x - i % b, b + i % b
        hit = names[0][a] == names[0][x + b]
        t, a, q, i = t[hit], a[hit], q[hit], (i - i % b)[hit]
        f = z_forward(names, a, a + q, k)
        g = z_backward(names, a, a + q, k)
        order = np.lexsort((i, q, t))
        t, q, s, e = t[order], q[order], (i - g)[order], (i + f)[order]
        if not len(t):
            continue
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (q[1:] != q[:-1]) | (s[1:] > e[:-1])))
        lead = np.flatnonzero(new)
        t, q, s, e = t[lead], q[lead], s[lead], e[np.concatenate((lead[1:], [len(e)])) - 1]
        far = ~whole[t] & ((s <= first[t] - b) | (e >= (last[t] - 1) // b * b + b))
        keep = far | (e - s >= np.maximum(q, min_words - q))
        found.append(np.stack([t[keep], q[keep], s[keep], e[keep]], 1))
    out = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    # of a whole document's stretches with the same ends, multiples of the smallest period can go at once
    out = out[np.lexsort((out[:, 1], out[:, 3] + out[:, 1], out[:, 2], out[:, 0]))]
    ends = np.stack([out[:, 0], out[:, 2], out[:, 3] + out[:, 1]], 1)
    again = np.concatenate(([False], (ends[1:] == ends[:-1]).all(1))) if len(out) else np.empty(0, bool)
    return out[~(again & whole[out[:, 0]])]


def _solved(heads, tiles, min_words):
    tiles_left = repetitive(tiles)
    where = {id(t): k for k, t in enumerate(tiles)}
    if not tiles_left:
        return None
    found = solve(tiles_left, min_words)
    owner = [heads[where[id(t)]] for t in tiles_left]
    ids, rows, ns = ([owner[k][c] for k in found[:, 0]] for c in range(3))
    return [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(ns, pa.int64()),
            *(pa.array(found[:, c]) for c in (1, 2, 3))]


def _explode(min_words: int, tile: int, small: int):
    """Pieces of the documents that are one tile; tiles of the longer ones."""
    def run(batches):
        heads, tiles, size = [], [], 0
        names = [c.split()[0] for c in f"{PIECES}, {TILES}".split(", ")]
        names = names[:6] + names[9:]

        def out(pieces=None, cut=None):
            rows = len(pieces[0]) if pieces else len(cut[0])
            left = [pa.nulls(rows, kind) for kind in (pa.int64(),) * 3]
            right = [pa.nulls(rows, kind) for kind in (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            columns = pieces + right if pieces else cut[:3] + left + cut[3:]
            return pa.RecordBatch.from_arrays(columns, names)
        for part in rows_in_slices(batches):
            ids, keys = part.column(0), part.column(1)
            texts = part.column(2).cast(pa.binary())
            for r in range(part.num_rows):
                words = (texts[r].as_py() or b"").split()
                if len(words) < min_words:
                    continue
                head, numbers = (ids[r].as_py(), keys[r].as_py(), len(words)), word_numbers(words)
                plan = tiles_of(len(words), tile, small)
                if len(plan) == 1:
                    lo, hi, first, last, base, _ = plan[0]
                    heads.append(head)
                    tiles.append((lo, hi, first, last, base, True, numbers))
                    size += len(words)
                    if size >= BATCH:
                        if (pieces := _solved(heads, tiles, min_words)) is not None:
                            yield out(pieces)
                        heads, tiles, size = [], [], 0
                    continue
                for lo, hi, first, last, base, end in plan:
                    yield out(cut=[*(pa.array([v], pa.int64()) for v in head), pa.array([lo], pa.int32()), pa.array([hi], pa.int32()),
                                   *(pa.array([v], pa.int64()) for v in (first, last, base)),
                                   pa.array([numbers[base:end].astype("<i4").tobytes()], pa.binary())])
        if tiles and (pieces := _solved(heads, tiles, min_words)) is not None:
            yield out(pieces)
    return run


def _solve_tiles(min_words: int):
    def run(batches):
        names = [c.split()[0] for c in PIECES.split(", ")]
        for part in rows_in_slices(batches, 16):
            rows = part.to_pylist()
            heads = [(r["_id"], r["_row"], r["_n"]) for r in rows]
            tiles = [(r["_low"], r["_high"], r["_first"], r["_last"], r["_base"], False,
                      np.frombuffer(r["_words"], "<i4").astype(np.int64)) for r in rows]
            for lo in range(len(tiles)):  # one by one: a tile of a large octave is large
                if (pieces := _solved(heads[lo:lo + 1], tiles[lo:lo + 1], min_words)) is not None:
                    yield pa.RecordBatch.from_arrays(pieces, names)
    return run


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12,
         tile: int = TILE, small: int = SMALL) -> DataFrame:
    """(_id, _row, runs): the runs (start, length, period), sorted, of each text that has any.

    _row is a hash of the text, for ids that repeat. min_words is at least 12.
    """
    if min_words < 2 * STRETCH:
        raise ValueError(f"min_words must be at least {2 * STRETCH}")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("_text"))
    schema = PIECES + TILES.split("_n long", 1)[1]
    first = cut_lineage(rows.mapInArrow(_explode(min_words, tile, small), schema))
    names = [c.split()[0] for c in PIECES.split(", ")]
    cut = first.filter("_words IS NOT NULL").select(*[c.split()[0] for c in TILES.split(", ")])
    cut = cut.repartition(shuffle_width(docs.sparkSession), "_id", "_row", "_low", "_first")
    pieces = first.filter("_words IS NULL").select(*names).unionByName(cut.mapInArrow(_solve_tiles(min_words), PIECES))
    # touching pieces of a document and period are one stretch
    doc = ["_id", "_row"]
    by = Window.partitionBy(*doc, "_period").orderBy("_from", "_to")
    seen = F.max("_to").over(by.rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumn("_new", F.coalesce((F.col("_from") > seen).cast("int"), F.lit(1)))
    pieces = pieces.withColumn("_stretch", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy(*doc, "_period", "_stretch").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    whole = whole.filter(F.col("_to") - F.col("_from") >= F.greatest("_period", min_words - F.col("_period")))
    own = whole.groupBy(*doc, "_from", (F.col("_to") + F.col("_period")).alias("_end")).agg(F.min("_period").alias("_period"))
    one = F.struct(F.col("_from").alias("start"), (F.col("_end") - F.col("_from")).alias("length"), F.col("_period").alias("period"))
    return own.groupBy(*doc).agg(F.array_sort(F.collect_list(one)).alias("runs"))


def _spot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))


def _chosen(wanted, hit: bool):
    """The rows whose id may (hit) or cannot have runs."""
    def run(batches):
        bits = wanted.value
        for part in rows_in_slices(batches):
            spot = part.column(2).to_numpy(zero_copy_only=False)
            may = (bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
            part = part.select([0, 1, 3]).filter(pa.array(may if hit else ~may))
            yield pa.RecordBatch.from_arrays(part.columns, ["_id", "_row", "_text"])
    return run


def _collapse(batches):
    for part in rows_in_slices(batches):
        texts, found = part.column(1).cast(pa.binary()), part.column(2)
        n, kept = [], []
        for r in range(part.num_rows):
            words = (texts[r].as_py() or b"").split()
            n.append(len(words))
            depth = np.zeros(len(words) + 1, np.int64)
            for run in found[r].as_py() or ():
                depth[run["start"] + run["period"]] += 1
                depth[run["start"] + run["length"]] -= 1
            if depth.any():
                words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), found, pa.array(kept, pa.string())],
                                         ["_id", "n_words", "runs", "collapsed"])


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12,
                  tile: int = TILE, small: int = SMALL) -> DataFrame:
    """One row per input row: <id_col>, n_words, runs, collapsed (words behind a run's first period left out).

    A run is a stretch of words with smallest period q and at least max(min_words, 2q) words that
    no neighbouring word extends. Null and empty texts have no words, no runs and collapse to the
    empty text. Rows with a null id, or that repeat an id or a whole row, are treated each by its
    own text. An empty table gives an empty result. Other columns, whatever their names, are ignored.
    Texts without runs are not shuffled.
    """
    found = cut_lineage(runs(docs, id_col, text_col, min_words, tile, small))
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(found.select("_id")))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_row"),
                       F.col(text_col).alias("_text")).select("_id", "_row", _spot("_id").alias("_spot"), "_text")
    kind = "_id long, _row long, _text string"
    may, without = rows.mapInArrow(_chosen(bits, True), kind), rows.mapInArrow(_chosen(bits, False), kind)
    found = found.select(F.col("_id").alias("_doc"), F.col("_row").alias("_key"), "runs")
    may = may.join(found, may["_id"].eqNullSafe(found["_doc"]) & (may["_row"] == found["_key"]), "left")
    none = F.array().cast(RUNS)
    both = may.select("_id", "_text", F.coalesce("runs", none).alias("runs")).unionByName(
        without.select("_id", "_text", none.alias("runs")))
    out = both.mapInArrow(_collapse, f"_id long, n_words long, runs {RUNS}, collapsed string")
    return out.select(F.col("_id").alias(id_col), "n_words", "runs", "collapsed")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, a tenth of them (by the id's checksum) with a periodic tail in place of their own."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE), lambda w: w != "")
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_whole"), F.floor(h / 10).cast("long").alias("_g"),
                       F.when(h % 10 == 0, words).alias("_words"))
    n, some = F.size("_words").cast("long"), F.size("_words") > 0
    rows = rows.withColumn("_a", F.when(some, F.col("_g") % n))
    rows = rows.withColumn("_p", F.when(some, F.expr("1 + (size(_words) - _a) div (3 + _g % 8)")))
    word = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
        "_words", F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i).cast("int")))
    return rows.select(id_col, F.when(some, F.array_join(word, " ")).otherwise(F.col("_whole")).alias(text_col))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"),
                                                             r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                   F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("_top"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("_top.less"), F.col("_top.period")
    return rows.select("doc_id", "n_runs", F.col("_top.start").alias("start"), length.alias("length"), period.alias("period"),
                       F.expr("1000 * -_top.less div _top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Pairs of equal 6-word windows of a document, by distance; consecutive ones are a stretch. The checksum bit by bit.
SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(
             string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS h
  FROM documents),
v AS (
  SELECT r, doc_id, ws, len(ws) AS n, h, h // 10 AS g,
         CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM c),
d AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i:
           ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) END AS ws
  FROM v),
s AS (SELECT r, i, hash(ws[i + 1:i + 6]) AS w FROM d, unnest(range(n - 5)) AS t(i) WHERE n >= 12),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.r = y.r AND x.w = y.w AND x.i < y.i),
k AS (SELECT r, i, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
m AS (SELECT r, q, min(i) AS f, max(i) + 6 AS t FROM k GROUP BY r, q, island),
o AS (SELECT r, f AS start, t + q - f AS length, min(q) AS period FROM m
      WHERE t - f >= greatest(q, 12 - q) GROUP BY r, f, t + q),
u AS (SELECT r, count(*) AS n_runs, min((-length, start, period)) AS top,
             string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
      FROM o GROUP BY r),
g AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM o),
w AS (SELECT d.r, string_agg(d.ws[p.i + 1], ' ' ORDER BY p.i) AS kept
      FROM d CROSS JOIN unnest(range(d.n)) AS p(i) LEFT JOIN g ON g.r = d.r AND g.i = p.i WHERE g.i IS NULL GROUP BY d.r)
SELECT d.doc_id, coalesce(u.n_runs, 0) AS n_runs, top[2] AS start, -top[1] AS length, top[3] AS period,
       1000 * -top[1] // top[3] AS exponent_milli, sha256(coalesce(u.listed, '')) AS runs_sha256,
       sha256(coalesce(w.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN u USING (r) LEFT JOIN w USING (r)
"""
