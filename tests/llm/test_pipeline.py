import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from .conftest import SF
from .test_dedup import brute_exact, brute_near
from .test_mix_bpe import brute_targets, words

import corpus_pipeline
from panelcast.llm import byte_bpe, language_id, mixing


def brute_mix(rows):
    """How often each document is in the mix."""
    sizes, out = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets = brute_targets(sizes)
    at = dict.fromkeys(sizes, 0)
    for i, t, s in sorted(rows, key=lambda r: (hashlib.md5(f"{r[0]}mix".encode()).hexdigest(), r[0])):
        n = words(t)
        a, goal = at[s], int(targets[s] + 1e-6)
        at[s] += n
        taken = sum(max(0, min(a + e * sizes[s] + n, goal) - min(a + e * sizes[s], goal)) for e in range(3))
        if n:
            out[i] = int(taken / n + 0.5)
    return out


def test_run_equals_brute_force(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in language_id.identify(docs, docs).collect()}
    rows = [(i, t, s) for i, t, _, s in documents if found[i].lang_pred != "und" and found[i].score >= corpus_pipeline.MIN_SCORE]
    assert all(any(c.isalpha() for c in t) for _, t, _ in rows) and len(rows) > 190
    keep = {r[0] for r in brute_exact([(i, t) for i, t, _ in rows]) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    keep = {r[0] for r in brute_near([(i, t) for i, t, _ in rows]) if r[3]}
    rows = [r for r in rows if r[0] in keep]
    times, text = brute_mix(rows), {i: t for i, t, _ in rows}
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, n in times.items():
        ids = own.encode_ordinary(text[i])
        want += [(i, len(ids), np.array(ids, "<u4").tobytes(), hashlib.sha256(text[i].encode()).hexdigest())] * n
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns_and_bear_empty_tables(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []
        if name != "encode":
            assert out.columns == docs.columns


def test_without_labels_nothing_with_a_letter_is_lost(spark, frame):
    docs = frame([(1, "the text of a document", None, "s"), (2, "another text", None, "s"), (3, "12", None, "s"), (4, None, None, "s")])
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()) == [1, 2]
    docs = frame([(1, "long text " * 9_000, "en", "s"), (2, "und noch ein text " * 5_000, "de", "s")])  # too long to learn from
    assert corpus_pipeline.identify_language(spark, docs, SF).count() == 2


def test_repeated_rows_become_one(spark, frame):
    docs = frame([(1, "the text of a document that repeats", "en", "s")] * 3 + [(2, "and one more of another kind", "en", "s")])
    for _name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2]


def test_the_mix_is_written_in_the_order_of_its_schedule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    slots = {r.doc_id: [p.slot for p in r.rounds] for r in mixing.placements(docs).collect()}
    got = [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    nth, seen = {}, []
    for i in got:
        seen.append(slots[i][nth.get(i, 0)])
        nth[i] = nth.get(i, 0) + 1
    assert seen == sorted(seen) and max(nth.values()) > 1


def test_stages_bear_odd_rows(spark, frame):
    docs = frame([(1, "the text of a document", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (3, "the text of a document", "en", "s"),
                  (None, "another text without an id", "de", None), (4, "12", "en", "s"), (5, "long text " * 30_000, "en", "s")])
    for _name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = docs.collect()
    assert {r.doc_id for r in got} >= {5} and not {r.doc_id for r in got} & {2, 4}
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
