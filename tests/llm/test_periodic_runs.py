import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import periodic_runs


def brute_runs(words, min_words=12):
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(min_words, 2 * q):
                found.setdefault((s, i + q), q)  # periods rise: the first is the smallest
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    out = [None, "", "  \n", "a", "a " * 11, "a " * 12, "x " + "a " * 40 + "y", "a b " * 6, "a b " * 5 + "a c", "A a " * 9]
    for _ in range(120):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(15))]
            unit = [rng.choice("ab") for _ in range(rng.randrange(1, 30))]
            words += (unit * 12)[:rng.randrange(1, 12 * len(unit))]
        out.append(" ".join(words))
    for p in (63, 64, 65, 200):  # long periods, cut at odd places
        unit = [str(rng.randrange(500)) for _ in range(p)]
        out.append(" ".join(["s"] * 3 + (unit * 4)[:3 * p + 17] + ["t"]))
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 400:
        fib.append(fib[-1] + " " + fib[-2])
    out += [fib[-1], " ".join(rng.choice("ab") for _ in range(700)), "k " * 900, "one two\tthree\n" * 120]
    return out


@pytest.mark.parametrize("tile, small", [(1 << 14, 10), (64, 2), (32, 0)])
def test_runs_equal_brute_force(frame, tile, small):
    rows = list(enumerate(texts())) + [(3, "q " * 30), (3, "q " * 30), (None, "r s " * 20), (None, "t " * 5)]
    docs = frame([(i, t, "en", "s") for i, t in rows]).repartition(5)
    got = periodic_runs.periodic_runs(docs, tile=tile, small=small).collect()
    want = []
    for i, t in rows:
        words = (t or "").split()
        found = brute_runs(words)
        want.append((i, len(words), found, brute_collapse(words, found)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_z_functions_equal_direct_comparison():
    rng = np.random.default_rng(5)
    words = np.concatenate((rng.integers(0, 2, 300), [-7]))
    names = periodic_runs.window_names(words, 6)
    a = np.repeat(np.arange(0, 300, 7), 40)
    b = np.minimum(a + np.tile(np.arange(1, 41), len(a) // 40), 299)
    keep = b > a
    a, b = a[keep], b[keep]
    for k in (0, 2, 5):
        f, g = periodic_runs.z_forward(names, a, b, k), periodic_runs.z_backward(names, a, b, k)
        for x, y, up, down in zip(a, b, f, g, strict=True):
            want = next((t for t in range(1 << k) if y + t >= 300 or words[x + t] != words[y + t]), 1 << k)
            back = next((t for t in range(1 << k) if x - t < 1 or words[x - t - 1] != words[y - t - 1]), 1 << k)
            assert (up, down) == (want, back)


def test_tiles_cover_every_anchor_and_what_it_needs():
    for n in (1, 2, 3, 40, 64, 65, 1000):
        top = n.bit_length() - 2
        seen = {}
        for low, high, first, last, base, end in periodic_runs.tiles_of(n, 64, 2):
            for k in range(low, high + 1):
                assert first % (1 << k) == 0
                seen.setdefault(k, []).append((first, last))
                assert base <= max(0, first - (1 << k)) and end >= min(n, last - 1 + 3 * (1 << k))
        assert sorted(seen) == list(range(top + 1))
        for parts in seen.values():
            assert [p for p, _ in sorted(parts)] == [0, *[e for _, e in sorted(parts)][:-1]] and max(e for _, e in parts) == n


def test_planted_tails(frame):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(200)] + [(None, "a b c"), (5, None)]
    got = periodic_runs.planted(frame([(i, t, "en", "s") for i, t in rows])).select("doc_id", F.coalesce("text", F.lit(""))).collect()
    want = []
    for i, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        want.append((i, " ".join(words)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(frame):
    assert periodic_runs.periodic_runs(frame([])).collect() == []
