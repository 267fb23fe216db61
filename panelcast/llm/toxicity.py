"""Toxicity by a classifier chain of sparse linear models.

Categories are predicted one after the other; each model sees the words of the whole text
and the probabilities of all earlier categories. In training those probabilities are
out-of-fold, so that a later model never sees an earlier one's answers on its own rows.
Words are chosen, and the models fitted, on a bounded sample of labelled rows.

The labels hold one category, `toxic`. The chain predicts `severe` first: toxic rows that
hold at least as many different telling words (the chosen words that speak for toxicity)
as the median toxic row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import fold_of, received, ship, smallest_per_class, table

CATEGORIES = ("severe", "toxic")
#: Bounds of the training sample and of the vocabulary.
PER_CLASS, VOCABULARY, LEAST_ROWS = 4000, 512, 5
FOLDS, STEPS, L1 = 5, 200, 3e-4

_TOKEN = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The different lower-cased words (runs of letters) of the whole text."""
    return set(_TOKEN.findall((text or "").lower()))


def _words_column():
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([sorted(words(t if isinstance(t, str) else None)) for t in s], dtype=object)
    return F.pandas_udf(run, "array<string>")


class Linear:
    """Logistic regression with an L1 penalty, by accelerated proximal steps; both classes weigh the same."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, k = x.shape
        share = np.clip(y.mean(), 1 / (n + 1), n / (n + 1))
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        z = np.hstack([x, np.ones((n, 1))]).astype(np.float32)
        y = y.astype(np.float32)
        v = np.ones(k + 1, np.float32)
        for _ in range(15):  # the largest curvature, by power steps
            v = z.T @ (weight * (z @ v))
            top = float(np.linalg.norm(v))
            v /= top
        rate = np.float32(4 * n / max(top, 1e-9) / 1.1)
        w = np.zeros(k + 1, np.float32)
        u, t = w.copy(), 1.0
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ u, -30, 30)))
            new = u - rate * (z.T @ (weight * (p - y)) / n)
            new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - rate * L1)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            u = new + np.float32((before - 1) / t) * (new - w)
            w = new
        self.w, self.bias = w[:-1].astype(float), float(w[-1])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.bias, -30, 30)))


class Chain:
    """One Linear model a category; each sees the words and the earlier probabilities."""

    def __init__(self, vocabulary: list[str], x: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS):
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.models: dict[str, Linear] = {}
        fold = np.arange(len(x)) % folds  # rows come in hash order
        for name, y in labels.items():
            self.models[name] = Linear(x, y)
            out_of_fold = np.zeros(len(x))
            for k in range(folds):
                inside = fold == k
                if inside.any():
                    out_of_fold[inside] = (Linear(x[~inside], y[~inside]).predict(x[inside])
                                           if (~inside).any() else y.mean())
            x = np.hstack([x, out_of_fold[:, None]])

    def presence(self, texts: list[set[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.vocabulary)))
        for i, found in enumerate(texts):
            x[i, [self.vocabulary[w] for w in found & self.vocabulary.keys()]] = 1.0
        return x

    def predict(self, texts: list[set[str]]) -> dict[str, np.ndarray]:
        x, out = self.presence(texts), {}
        for name, model in self.models.items():
            out[name] = model.predict(x)
            x = np.hstack([x, out[name][:, None]])
        return out


def fit(docs: DataFrame, marks: DataFrame, text_col: str = "text", per_class: int = PER_CLASS) -> Chain | None:
    """Fits on docs (_id, text) and marks (_id, _y 0/1): at most `per_class` ids a class, by smallest
    hash. None unless both classes occur."""
    spark = docs.sparkSession
    marks = marks.groupBy("_id").agg(F.max("_y").alias("_y")).withColumn("_hash", F.xxhash64("_id"))
    chosen = smallest_per_class(marks.join(docs.select("_id").distinct(), "_id", "left_semi"), "_y", "_hash", per_class)
    rows = docs.join(F.broadcast(chosen), "_id").select("_y", "_hash", _words_column()(F.col(text_col)).alias("_w"))
    # copies count once
    rows = rows.dropDuplicates(["_y", "_w"]).persist()
    sizes = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    if set(sizes) != {0, 1}:
        rows.unpersist()
        return None
    counts = rows.select("_y", F.explode("_w").alias("_t")).groupBy("_t").agg(
        F.sum("_y").alias("_one"), F.sum(1 - F.col("_y")).alias("_zero"))
    a, b = F.col("_one") / sizes[1], F.col("_zero") / sizes[0]
    both = (F.col("_one") + F.col("_zero")) / (sizes[0] + sizes[1])
    z = (a - b) / F.sqrt(both * (1 - both) * (1 / sizes[0] + 1 / sizes[1]) + 1e-9)
    telling = (counts.filter(F.col("_one") + F.col("_zero") >= LEAST_ROWS)
               .select("_t", z.alias("_z")).orderBy(F.abs("_z").desc(), "_t").limit(VOCABULARY).collect())
    vocabulary = [r["_t"] for r in telling]
    for_it = {r["_t"] for r in telling if r["_z"] > 2}
    known = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    sample = rows.select("_y", "_hash", F.array_intersect("_w", known).alias("_w")).collect()
    rows.unpersist()
    sample = sorted(((r["_hash"], r["_y"], set(r["_w"])) for r in sample), key=lambda r: (r[0], r[1], sorted(r[2])))
    y = np.array([float(r[1]) for r in sample])
    strength = np.array([len(r[2] & for_it) for r in sample])
    severe = (y == 1) & (strength >= np.median(strength[y == 1]))
    place = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(sample), len(vocabulary)))
    for i, r in enumerate(sample):
        x[i, [place[w] for w in r[2]]] = 1.0
    return Chain(vocabulary, x, {"severe": severe.astype(float), "toxic": y})


def score_column(spark: SparkSession, model: Chain | None, categories: tuple = CATEGORIES):
    """Pandas UDF: text -> struct of the probability of each category."""
    shared = ship(spark, model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chain = received(shared)
        for s in parts:
            found = {c: np.zeros(len(s)) for c in categories}
            for at in range(0, len(s) if chain else 0, 1024):
                part = [words(t if isinstance(t, str) else None) for t in s.iloc[at:at + 1024]]
                for c, p in chain.predict(part).items():
                    found[c][at:at + len(part)] = p
            yield pd.DataFrame(found)
    return F.pandas_udf(run, ", ".join(f"{c} double" for c in categories))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", folds: int = 3, held_out_fold: int = 1,
                   threshold: float = 0.5) -> DataFrame:
    """One row per row of `docs`: <id_col>, held_out, severe, score, predicted.

    score is the probability of `toxic`, severe that of the earlier category, predicted is 1
    from `threshold` on. Labels of held-out ids are not used. Null, empty and wordless texts
    are scored as texts without any word. Label rows with a null id or label, or an id without a
    document, are ignored; of contradictory labels of an id the larger holds. Without labels
    of both classes all scores are 0. Repeated rows are scored each; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held_out = fold_of(F.col("_id"), folds) == held_out_fold
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marks = marks.filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out)
    model = fit(rows, marks, "_text")
    scored = rows.select("_id", held_out.alias("_out"),
                         score_column(docs.sparkSession, model)(F.col("_text")).alias("_p"))
    return scored.select(F.col("_id").alias(id_col), F.col("_out").alias("held_out"), F.col("_p.severe").alias("severe"),
                         F.col("_p.toxic").alias("score"), (F.col("_p.toxic") >= threshold).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
