import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from panelcast.llm import byte_bpe, mixing

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(RANK_FILE)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute_targets(sizes, weights=(5, 2, 1), times=3):
    """Water filling, round by round."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if times * sizes[s] <= w[s] * level}
        if not full:
            out |= {s: w[s] * level for s in free}
            break
        for s in full:
            out[s] = float(times * sizes[s])
            left -= times * sizes[s]
        free -= full
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check_mix(rows, got):
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    want = brute_targets(sizes)
    source = {(i, words(t)): s for i, t, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1


def test_mix_of_given_documents(spark, documents):
    check_mix(documents, mixing.op7_mix(spark, "/root/testdata/sf0.001").collect())


def test_mix_edge_cases(frame):
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(0, 40), "en", rng.choice(["b", "a", None, "é", "Z", "hot", "hot", "hot"])) for k in range(300)]
    rows += [(1000, None, None, None), (1001, "", "en", "empty"), (1002, "long word " * 20_000, "en", "hot"), (None, "no id", "en", "a"),
             (1003, "x y", "en", "tiny")]
    docs = frame(rows)
    first = mixing.mix(docs).collect()
    check_mix(rows, first)
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix(docs.repartition(9)).collect()))
    assert mixing.mix(frame([])).collect() == []
    nothing = mixing.mix(frame([(1, "", "en", "a"), (2, None, "en", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0), (0, 0.0, 0)]


def test_schedule_is_spread_evenly(spark, frame):
    rows = [(k, "w " * 50, "en", "abc"[k % 3]) for k in range(90)]
    goals = mixing.targets(mixing.sized(frame(rows), "doc_id", "text", "source", "mix"))
    plan = sorted((r.slot, r._src, r.rank) for r in mixing.schedule(spark, goals, 8000).collect())
    assert [s for s, _, _ in plan] == list(range(8000))
    share = {g._src: g.target / 4500 for g in goals.collect()}
    for upto in (80, 800, 8000):  # every prefix holds the sources in proportion
        for src, p in share.items():
            assert abs(sum(s == src for _, s, _ in plan[:upto]) - p * upto) < 6
    for src in share:
        assert [r for _, s, r in plan if s == src] == list(range(sum(s == src for _, s, _ in plan)))


def test_repeat_documents(frame):
    rows = [(k, "w " * 10, "en", "a") for k in range(30)] + [(100, "u " * 10, "en", "b"), (101, "", "en", "b"), (102, "x", "en", "c")]
    docs = frame(rows)
    taken = {r.doc_id: r for r in mixing.mix(docs).collect()}
    got = mixing.repeat_documents(docs)
    assert got.columns == docs.columns
    times = {}
    for r in got.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {i: int(r.taken / r.size + 0.5) for i, r in taken.items() if r.size and r.taken / r.size >= 0.5}
    assert times[100] == 3 and times[102] == 3  # small sources are repeated up to the limit


def expected(text):
    ids = TIKTOKEN.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_encoding_of_given_documents(spark, documents):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: expected(t) for i, t, *_ in documents}


def test_encoding_edge_cases(frame):
    rng = random.Random(2)
    pieces = ["a", "the ", " ", "\n", "\t", "\x1c", "\x85", " ", "é", "́", "1", "٣", "!", "漢", "😀", "'s", "'ll", "​", "²", "_", "<|endoftext|>"]
    texts = [None, "", " ", "\0", "x" * 70_000, " " * 5000, "=" * 5000, "é" * 3000, "words and words " * 20_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(3, "same id", "en", "s"), (None, "no id", "en", "s")]
    got = byte_bpe.digests(frame(rows).repartition(3), RANK_FILE, public_tokenizers.PATTERN).collect()
    want = sorted(((i, *expected(t)) for i, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert byte_bpe.digests(frame([]), RANK_FILE, public_tokenizers.PATTERN).collect() == []


def test_small_blocks_give_the_same_ids(spark, documents, frame):
    docs = frame(documents[:60])
    a = byte_bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, block_tokens=50).collect()
    b = byte_bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_decode_gives_the_bytes_back(frame, documents):
    docs = frame(documents[:40])
    coded = byte_bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, decoded=True)
    twice = byte_bpe.decode(coded, RANK_FILE, to_col="again").collect()
    text = {i: (t or "").encode() for i, t, *_ in documents[:40]}
    assert all(r.again == r.decoded == text[r.doc_id] for r in twice) and len(twice) == 40


def test_texts_are_cut_once(frame):
    df = byte_bpe.encode(frame([(1, "a b", "en", "s")]), RANK_FILE, public_tokenizers.PATTERN)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_long_words_merge_alike():
    rng = random.Random(9)
    for n in (2, 50, 97, 400, 3000):
        word = "".join(rng.choice("etaoinshrdlu") for _ in range(n)).encode()
        assert byte_bpe.encode_word(word, RANKS) == byte_bpe._encode_long(word, RANKS) == TIKTOKEN.encode_ordinary(word.decode())


def test_source_of_a_ten_millionth_of_the_words(spark):
    docs = spark.range(20).selectExpr("id AS doc_id", "repeat('w ', 500000) AS text", "if(id < 10, 'a', 'b') AS source")
    docs = docs.unionAll(spark.sql("SELECT 100L, 'w', 'bb'")).unionAll(spark.sql("SELECT 101L, 'w w', 'c'"))
    got = {r.doc_id: (r.size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got[100] == (1, 3.0, 3) and got[101] == (2, 6.0, 6)
    assert sum(taken for _, _, taken in got.values()) in (10_000_002, 10_000_003)
    plan = mixing.schedule(spark, mixing.targets(mixing.sized(docs, "doc_id", "text", "source", "mix")), 1000).collect()
    assert sorted(r.slot for r in plan) == list(range(1002)) and {r.n_slots for r in plan if r.slot >= 1000} == {1}
