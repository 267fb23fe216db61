import zlib

import numpy as np
import pytest
from .conftest import SF
from pyspark.sql import functions as F

from panelcast.llm import language_id, quality, toxicity

BIG = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = language_id.op3_language_id(spark, BIG).join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out and r.n >= 50]
    assert np.mean(held) > 0.97


def test_language_edge_cases(spark, frame):
    train = frame([(k, t + f" {k}", lang, "s") for k in range(30) for lang, t in
                   (("en", "the cat and the dog went to the house"), ("de", "der hund und die katze gehen nach haus"))])
    docs = frame([(1, None, "en", "s"), (2, "", "en", "s"), (3, "12 345 !?", "en", "s"), (4, "und die hunde gehen", None, "s"),
                  (5, "the dogs went to", "de", "s"), (5, "the dogs went to", "de", "s"), (6, "the dog and " * 20_000, None, None),
                  (7, "ж", None, None), (None, "the house", "en", "s")])
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs, train).collect()]
    assert len(got) == 9
    found = {i: lang for i, lang, _ in got}
    assert [found[i] for i in (1, 2, 3, 4, 5, 6, None)] == ["und", "und", "und", "de", "en", "en", "en"]
    assert found[7] in ("de", "en")
    assert all(s == 0 for i, _, s in got if i in (1, 2, 3))
    assert sorted(r.doc_id or 0 for r in language_id.accept(docs, train).collect()) == [0, 4, 5, 5, 6, 7]
    assert sorted(r.doc_id or 0 for r in language_id.accept(docs, train, languages=("en",)).filter("doc_id <> 7").collect()) == [5, 5, 6]
    score = {i: s for i, _, s in got}
    assert {r.doc_id for r in language_id.accept(docs, train, min_score=score[7] + 1e-6).collect()} == {
        i for i, lang, s in got if lang != "und" and s > score[7]}
    assert language_id.accept(docs, train).columns == docs.columns


def test_language_without_training_rows(frame):
    docs = frame([(1, "the cat", None, "s")])
    assert [(r.lang_pred, r.score) for r in language_id.identify(docs, docs).collect()] == [("und", 0.0)]
    assert language_id.identify(frame([]), frame([])).collect() == []
    # nothing to learn from: what may have a language stays
    docs = frame([(1, "the cat", None, "s"), (2, "12", None, "s"), (3, None, "en", "s"), (4, "long " * 9_000, "en", "s")])
    assert sorted(r.doc_id for r in language_id.accept(docs, docs).collect()) == [1, 4]


#: The first words of one sentence in a dozen languages and nine scripts.
SCRIPTS = {
    "en": "all human beings are born free and equal in dignity and rights they are endowed with reason",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft begabt",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом",
    "uk": "всі люди народжуються вільними і рівними у своїй гідності та правах вони наділені розумом",
    "el": "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิต่างมีเหตุผลและมโนธรรม",
    "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
    "ja": "すべての人間は生まれながらにして自由でありかつ尊厳と権利とについて平等である",
}


def test_a_dozen_languages_in_nine_scripts():
    rng = np.random.default_rng(1)

    def sample(text):
        parts = text.split() if " " in text else list(text)
        return (" " if " " in text else "").join(rng.choice(parts, 12 if " " in text else 25))
    langs = [lang for lang in SCRIPTS for _ in range(20)]
    model = language_id.KernelRidge([sample(SCRIPTS[lang]) for lang in langs], langs, per_lang=8)
    for lang, text in SCRIPTS.items():
        got, _ = model.predict([sample(text) for _ in range(15)])
        assert sum(x == lang for x in got) >= 14


def test_folded_weights_equal_the_kernel_machine():
    """Scores by the folded matrix are those of explicit kernels against the landmarks."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdefgh  " if k % 2 else "efghijkl  "), 80)) for k in range(60)]
    langs = ["x" if k % 2 else "y" for k in range(60)]
    model = language_id.KernelRidge(texts, langs, per_lang=10)
    seen = np.zeros(language_id.NGRAMS, bool)
    grams = [set(language_id.ngrams(t, seen).tolist()) for t in texts]
    marks = [k for k in range(60) if langs[k] == "x"][:10] + [k for k in range(60) if langs[k] == "y"][:10]
    kernel = np.array([[len(a & grams[m]) / np.sqrt(len(a) * len(grams[m])) for m in marks] for a in grams])
    values, vectors = np.linalg.eigh(kernel[marks])
    good = values > 1e-6 * values.max()
    z = kernel @ (vectors[:, good] / np.sqrt(values[good]))
    y = np.where(np.array(langs)[:, None] == np.array(model.langs)[None], 1.0, -1.0)
    w = np.linalg.solve((z - z.mean(0)).T @ (z - z.mean(0)) + language_id.RIDGE * 60 * np.eye(z.shape[1]),
                        (z - z.mean(0)).T @ (y - y.mean(0)))
    f = (z - z.mean(0)) @ w + y.mean(0)
    p = np.exp(language_id.SHARPNESS * (f - f.max(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    got, scores = model.predict(texts)
    assert got == [model.langs[k] for k in f.argmax(1)]
    assert np.allclose(scores, p.max(1), atol=1e-4)


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality.op10_quality(spark, BIG).collect()
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [truth[r.doc_id] == r.predicted for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(held) > 0.95


def test_quality_edge_cases(spark, frame):
    good = [(k, f"A quiet line about subject {k}. It goes on for a while, and ends here.", "en", "s") for k in range(40)]
    bad = [(100 + k, f"buy$$$ now### {k} %%% buy$$$ now###", "en", "s") for k in range(40)]
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (1002, "buy$$$ " * 30_000, "en", "s"), (None, "A line.", "en", "s"),
           (1003, "é 漢 😀", "en", "s")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(100 + k, 0, 0) for k in range(40)] +
                                   [(None, 1, 0), (5, None, 0), (77777, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(frame(good + bad + odd), labels).collect()}
    assert len(got) == 85
    assert np.mean([got[k].predicted == 1 for k in range(40)]) == 1 and np.mean([got[100 + k].predicted == 0 for k in range(40)]) == 1
    assert got[1002].predicted == 0 and 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    none = quality.score_quality(frame(good), labels.filter("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(frame([]), labels).collect() == []


def test_additive_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # only a pair can tell
    model = quality.AdditiveModel(x, y)
    score = model.score(x)
    assert np.mean((score >= 0.5) == y) > 0.85 and (0, 1) in model.pairs
    one = model.start + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, x[7], strict=True))
    cell = [np.searchsorted(e, v, side="right") for e, v in zip(model.coarse, x[7], strict=True)]
    one += sum(t[cell[i], cell[j]] for (i, j), t in model.pairs.items())
    assert score[7] == pytest.approx(1 / (1 + np.exp(-one)))


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op9_toxicity(spark, sf).collect()
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p for t, p in held if t]) > 0.8
    assert np.mean([p for t, p in held if not t]) < 0.02


def test_toxicity_edge_cases(spark, frame):
    clean = [(k, f"word{chr(97 + k % 20)} and a calm sentence number {k}", "en", "s") for k in range(60)]
    foul = [(100 + k, f"word{chr(97 + k % 20)} you nasty creature number {k}", "en", "s") for k in range(60)]
    odd = [(1000, None, None, None), (1001, "", "en", "s"), (1002, "calm " * 50_000 + "Nasty creature, you", "en", "s"),
           (None, "calm", "en", "s"), (1003, "123 !", "en", "s")]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100 + k, 1, 1) for k in range(60)] +
                                   [(None, 1, 1), (3, 1, None), (77777, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(clean + foul + odd), labels).collect()}
    assert len(got) == 125
    assert all(got[k].predicted == 0 for k in range(60)) and all(got[100 + k].predicted == 1 for k in range(60))
    assert got[1002].predicted == 1 and got[1000].score == got[1001].score == got[1003].score
    none = toxicity.score_toxicity(frame(clean), labels.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_toxicity(frame([]), labels).collect() == []


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    severe = (x[:, 0] * x[:, 1]).astype(float)
    chain = toxicity.Chain([f"w{k}" for k in range(6)], x, {"severe": severe, "toxic": np.maximum(severe, x[:, 2])})
    assert len(chain.models["severe"].w) == 6 and len(chain.models["toxic"].w) == 7
    p = chain.predict([{"w0", "w1"}, {"w2"}, set()])
    assert p["toxic"][0] > 0.5 and p["toxic"][1] > 0.5 and p["toxic"][2] < 0.5


def test_learns_nothing_from_the_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    langs, _ = model.predict(["xyz"])
    assert langs[0] in model.langs
