"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few dozen statistics (one pass, whole texts). On a bounded sample of labelled
rows, cyclic boosting visits the features in turn and fits a shallow tree on that feature's
bins to the logistic residuals; its leaves are added to the feature's lookup table. The
pairs of features whose coarse grids explain most of what remains get tables of their own,
boosted the same way with one cut in each feature. A score is the logistic of a sum of
table entries: bin numbers by binary search, then vectorised additions.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import fold_of, received, ship, smallest_per_class, table
from panelcast.session import cut_lineage

FEATURES = ("log_words", "word_length", "letters", "digits", "upper", "punctuation", "symbols", "bars", "marks",
            "spaces", "distinct_words", "top_word", "repeated_words", "repeated_pairs", "short_words",
            "odd_words", "upper_words", "title_words", "log_lines", "log_line_length", "repeated_lines",
            "ended_lines", "entropy", "sentence_words")
#: Bound of the training sample: labelled rows per class.
PER_CLASS = 10_000
BINS, ROUNDS, RATE, LEAVES, PAIRS, PAIR_BINS, PAIR_ROUNDS, SHRINK = 32, 120, 0.15, 3, 8, 8, 40, 8.0

_CLASS = np.full(256, 6, np.uint8)  # 6: letters beyond ASCII
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                             b" \t\n\r\x0b\x0c", b".,;:'\"()-")):
    _CLASS[list(_chars)] = _i
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{}~")] = 5
_CLASS[list(b"|")] = 7
_CLASS[list(b"!?")] = 8


def features(text: str | None) -> list[float]:
    """The statistics of one whole text; null counts as empty, an empty text gives zeros."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=9) / max(1, len(raw))
    n = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(words) - 1 - len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    letters = kinds[0] + kinds[1] + kinds[6]
    spread = np.bincount(raw, minlength=256)
    spread = spread[spread > 0] / max(1, len(raw))
    odd = sum(not w.rstrip(".,;:!?").isalpha() for w in words)
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    return [
        float(np.log1p(len(words))), float(lengths.mean()) if words else 0.0, letters, kinds[2],
        kinds[1] / max(letters, 1e-9), kinds[4], kinds[5], kinds[7], kinds[8], kinds[3],
        len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, pairs / n,
        float((lengths <= 3).mean()) if words else 0.0, odd / n, sum(w.isupper() for w in words) / n,
        sum(w.istitle() for w in words) / n, float(np.log1p(len(lines))),
        float(np.log1p(len(text) / max(1, len(lines)))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)),
        float(-(spread * np.log2(spread)).sum()) if len(raw) else 0.0, ends / n,
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Per bin, the leaf value of a best-first tree on the bins' sums (g: residuals, h: weights)."""
    gs, hs = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))

    def worth(a, b):
        return (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + SHRINK)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                if gain.max() > best[0]:
                    best = (gain.max(), (k, a, int(cut[gain.argmax()]), b))
        if best[1] is None:
            break
        k, a, cut, b = best[1]
        parts[k:k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + SHRINK)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts, one in each feature, on a grid of sums."""
    gs = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    hs = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = len(g)
    best, out = 0.0, np.zeros_like(g)
    for i, j in itertools.product(range(1, n), range(1, n)):
        boxes = ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, n)), (slice(i, n), slice(0, j)), (slice(i, n), slice(j, n)))
        sums = [(gs[b.stop, c.stop] - gs[b.start, c.stop] - gs[b.stop, c.start] + gs[b.start, c.start],
                 hs[b.stop, c.stop] - hs[b.start, c.stop] - hs[b.stop, c.start] + hs[b.start, c.start]) for b, c in boxes]
        gain = sum(x * x / (y + SHRINK) for x, y in sums)
        if gain > best:
            best, out = gain, np.zeros_like(g)
            for box, (x, y) in zip(boxes, sums, strict=True):
                out[box] = x / (y + SHRINK)
    return best, out


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = self._bins(x, self.edges)
        f = np.full(len(y), self.start)
        for _ in range(ROUNDS):
            for k, t in enumerate(self.tables):
                p = 1 / (1 + np.exp(-f))
                step = RATE * _tree(np.bincount(bins[k], y - p, len(t)), np.bincount(bins[k], p * (1 - p), len(t)), LEAVES)
                t += step
                f += step[bins[k]]
        grid = self._bins(x, self.coarse)

        def sums(i, j):
            p, cell = 1 / (1 + np.exp(-f)), grid[i] * PAIR_BINS + grid[j]
            return (np.bincount(cell, y - p, PAIR_BINS**2).reshape(PAIR_BINS, -1),
                    np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, -1))
        ranked = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda ij: (-_quarters(*sums(*ij))[0], ij))
        self.pairs = {ij: np.zeros((PAIR_BINS, PAIR_BINS)) for ij in ranked[:PAIRS]}
        for _ in range(PAIR_ROUNDS):
            for (i, j), t in self.pairs.items():
                step = RATE * _quarters(*sums(i, j))[1]
                t += step
                f += step[grid[i], grid[j]]

    @staticmethod
    def _bins(x, edges):
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for t, b in zip(self.tables, self._bins(x, self.edges), strict=True):
            f += t[b]
        grid = self._bins(x, self.coarse)
        for (i, j), t in self.pairs.items():
            f += t[grid[i], grid[j]]
        return 1 / (1 + np.exp(-f))


def described(docs: DataFrame, text_col: str, *keep) -> DataFrame:
    """The columns `keep` and the array _x of statistics of each text."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([features(t if isinstance(t, str) else None) for t in s], dtype=object)
    return docs.select(*keep, F.pandas_udf(run, "array<double>")(F.col(text_col)).alias("_x"))


def fit(rows: DataFrame, per_class: int = PER_CLASS) -> AdditiveModel | None:
    """Fits on rows (_x, _y): at most `per_class` distinct rows a class, by smallest hash.

    None unless both classes occur.
    """
    rows = rows.filter("_y IS NOT NULL").withColumn("_hash", F.xxhash64("_x"))
    rows = rows.dropDuplicates(["_y", "_hash"])
    sample = smallest_per_class(rows.select("_y", "_hash", "_x"), "_y", "_hash", per_class).collect()
    sample.sort(key=lambda r: (r["_y"], r["_hash"]))
    y = np.array([float(r["_y"]) for r in sample])
    return AdditiveModel(np.array([r["_x"] for r in sample]), y) if len(set(y)) == 2 else None


def score_column(spark: SparkSession, model: AdditiveModel | None):
    shared = ship(spark, model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = received(shared)
        for s in parts:
            yield pd.Series(fitted.score(np.array(s.tolist()).reshape(len(s), -1)) if fitted and len(s) else np.full(len(s), 0.5))
    return F.pandas_udf(run, "double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """One row per row of `docs`: <id_col>, held_out, score, predicted.

    Labels of held-out rows (crc32 of the id modulo `folds`) are not used. Null and empty
    texts get the score of an empty text. Label rows with a null or unknown id, or a null
    label, are ignored; contradictory labels of one id each count. Without labelled rows of
    both classes every score is 0.5. Repeated rows are scored each; an empty table gives
    an empty result; other columns are ignored.
    """
    held_out = fold_of(F.col(id_col), folds) == held_out_fold
    rows = cut_lineage(described(docs, text_col, F.col(id_col).alias("_id"), held_out.alias("_out")))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marks = marks.filter(F.col("_y").isin(0, 1))
    model = fit(rows.filter("NOT _out").join(marks, "_id").select("_x", "_y"))
    scored = rows.select("_id", "_out", score_column(docs.sparkSession, model)("_x").alias("_s"))
    return scored.select(F.col("_id").alias(id_col), F.col("_out").alias("held_out"), F.col("_s").alias("score"),
                         (F.col("_s") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
