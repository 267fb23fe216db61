"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1..3, blended) present in
both, normalised by the numbers present in each. An n-gram's number is a hash of its characters,
whatever their script, to NGRAMS places. A bounded sample of labelled texts is
mapped to Nyström features on landmark texts of every language; ridge regression, one
language against the rest, is solved in that space. The kernel is linear in the presence
vector, so landmarks, Nyström map and ridge weights fold into one matrix of n-grams x
languages: a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import fold_of, received, ship, smallest_per_class, table

#: Places of the n-grams' hashes.
BITS = 18
NGRAMS = 1 << BITS
#: Bounds of the training sample: texts and landmarks per language, characters per text.
PER_LANG, LANDMARKS, SHORTEST, LONGEST = 400, 48, 20, 20_000
RIDGE, SHARPNESS, BATCH = 1e-3, 4.0, 64
UNKNOWN = "und"


def ngrams(text: str, seen: np.ndarray) -> np.ndarray:
    """Distinct n-gram numbers of the whole text; `seen` is an all-false scratch array."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    two = c[:-1] * np.uint32(0x85EBCA6B) + c[1:] + np.uint32(1) if len(c) > 1 else c[:0]
    three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] + np.uint32(2) if len(c) > 2 else c[:0]
    every = np.concatenate((c, two, three))
    every = (every ^ (every >> np.uint32(15))) * np.uint32(0x9E3779B1)
    seen[every >> np.uint32(32 - BITS)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class KernelRidge:
    """Fitted classifier: n-gram columns, folded weights."""

    def __init__(self, texts: list[str], langs: list[str], per_lang: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        seen = np.zeros(NGRAMS, bool)
        grams = [ngrams(t, seen) for t in texts]
        rows: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            rows.setdefault(lang, []).append(i)
        marks = [i for lang in self.langs for i in rows[lang][:per_lang]]
        vocab = np.unique(np.concatenate([grams[i] for i in marks]))
        self.column = np.full(NGRAMS, len(vocab), np.int32)
        self.column[vocab] = np.arange(len(vocab), dtype=np.int32)
        base = np.zeros((len(vocab) + 1, len(marks)), np.float32)
        for k, i in enumerate(marks):
            base[self.column[grams[i]], k] = 1.0 / np.sqrt(len(grams[i]))
        base[len(vocab)] = 0
        kernel = np.concatenate([self._present(grams[at:at + BATCH], len(vocab)) @ base
                                 for at in range(0, len(grams), BATCH)]).astype(np.float64)
        values, vectors = np.linalg.eigh(kernel[marks])
        good = values > 1e-6 * values.max()
        nystrom = vectors[:, good] / np.sqrt(values[good])
        z = kernel @ nystrom
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        zm, ym = z.mean(0), y.mean(0)
        w = np.linalg.solve((z - zm).T @ (z - zm) + ridge * len(z) * np.eye(z.shape[1]), (z - zm).T @ (y - ym))
        self.bias = ym - zm @ w
        self.weights = (base @ (nystrom @ w)).astype(np.float32)

    def _present(self, grams: list[np.ndarray], width: int) -> np.ndarray:
        """Rows of presence, each divided by the root of the text's number of n-grams."""
        out = np.zeros((len(grams), width + 1), np.float32)
        for k, g in enumerate(grams):
            out[k, self.column[g]] = 1.0 / np.sqrt(len(g))
        out[:, width] = 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
        seen = np.zeros(NGRAMS, bool)
        for at in range(0, len(known), BATCH):
            part = known[at:at + BATCH]
            grams = [ngrams(texts[i], seen) for i in part]
            f = SHARPNESS * (self._present(grams, len(self.weights) - 1) @ self.weights + self.bias)
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, row in zip(part, p, strict=True):
                langs[i], scores[i] = self.langs[int(row.argmax())], float(row.max())
        return langs, scores


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
        per_lang: int = PER_LANG) -> KernelRidge | None:
    """Fits on at most `per_lang` distinct texts a language (those of smallest hash), each of
    SHORTEST..LONGEST characters with a letter; None if there is no such text."""
    rows = docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    rows = rows.filter("_lang IS NOT NULL AND _text IS NOT NULL").filter(
        F.length("_text").between(SHORTEST, LONGEST) & F.col("_text").rlike(r"\p{L}"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    # only hashes are shuffled; the sample's texts come by a second, filtered scan
    keys = smallest_per_class(rows.select("_lang", "_hash").distinct(), "_lang", "_hash", per_lang)
    texts = rows.join(F.broadcast(keys), ["_lang", "_hash"]).groupBy("_lang", "_hash").agg(F.min("_text").alias("_text"))
    sample = sorted((r["_lang"], r["_hash"], r["_text"]) for r in texts.collect())
    return KernelRidge([t for _, _, t in sample], [lang for lang, _, _ in sample]) if sample else None


def language_column(spark: SparkSession, model: KernelRidge | None):
    """Pandas UDF: text -> struct<lang, score>."""
    shared = ship(spark, model)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = received(shared)
        for s in parts:
            texts = [t if isinstance(t, str) else None for t in s]
            langs, scores = fitted.predict(texts) if fitted else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pd.DataFrame({"lang": langs, "score": scores})
    return F.pandas_udf(run, "lang string, score double")


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: <id_col>, lang_pred, score.

    Null texts and texts without a letter (empty ones too) are 'und' with score 0; so is
    everything if `train` has no usable row. Ties go to the first language by name. Repeated
    rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    scored = docs.select(F.col(id_col).alias("_id"),
                         language_column(docs.sparkSession, fit(train, text_col, lang_col))(F.col(text_col)).alias("_p"))
    return scored.select(F.col("_id").alias(id_col), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def accept(docs: DataFrame, train: DataFrame, text_col: str = "text", lang_col: str = "lang",
           languages: tuple[str, ...] | None = None, min_score: float = 0.0) -> DataFrame:
    """The rows of `docs` predicted to be in one of `languages` (None: any learned one) with at least min_score.

    Texts without a letter have no language and go. If `train` has no usable row, no language can be told: all
    texts with a letter stay. All columns are kept.
    """
    model = fit(train, text_col, lang_col)
    if model is None:
        return docs.filter(F.col(text_col).rlike(r"\p{L}"))
    found = language_column(docs.sparkSession, model)(F.col(text_col))
    good = (found["lang"] != UNKNOWN) & (found["score"] >= min_score)
    return docs.filter(good & found["lang"].isin(*languages) if languages is not None else good)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), language_column(spark, model)(F.col("text")).alias("_p"))
    return scored.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))
