import hashlib
import random
import re

import pytest

from panelcast.llm import components, exact_dedup, minhash_forest
from panelcast.llm import rare_links as rare_links_module
from panelcast.llm.rare_links import rare_links


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[normal(t)]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


EXACT = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (1, None), (2, ""), (4, "A b"), (None, "q"), (None, "q"), (7, "q"),
         (8, "z " * 30_000), (6, "z\n" * 30_000), (3, "a\tb"), (None, "w")]


@pytest.mark.parametrize("winners", [1, 2048])
def test_exact_dedup_equals_brute_force(spark, frame, winners):
    rows = EXACT + [(100 + k, "hot text") for k in range(300)] + [(1000 + k, f"text {k % 40}") for k in range(100)]
    docs = frame([(i, t, "en", "s") for i, t in rows]).repartition(5)
    got = exact_dedup.exact_dedup(docs, winners=winners).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_exact_dedup_plan_has_no_python(spark, frame):
    plan = exact_dedup.exact_dedup(frame([(1, "a", "en", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_drop_copies_keeps_columns_and_first_rows(frame):
    docs = frame([(5, "a  b", "en", "s"), (3, "a b", "de", "t"), (4, "c", None, None), (None, "d", "en", "s")])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, None}
    again = frame([(7, "a b", "en", "s")] * 3 + [(7, "other", "en", "s"), (8, "a  b", "en", "s"), (None, "x", "en", "s"), (None, "x", "en", "s")])
    assert sorted(((r.doc_id or 0), r.text) for r in exact_dedup.drop_copies(again).collect()) == [
        (0, "x"), (0, "x"), (7, "a b"), (7, "other")]


def test_empty_tables(frame):
    docs = frame([])
    assert exact_dedup.exact_dedup(docs).collect() == []
    assert minhash_forest.near_dedup(docs).collect() == []
    assert minhash_forest.drop_near_copies(docs).collect() == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_near(rows):
    """All pairs of different sets, each set standing for its rows under their smallest id."""
    sets = [(i, frozenset(shingles(t))) for i, t in rows]
    lead = {}
    for i, s in sets:
        if i is not None and s:
            lead[s] = min(i, lead.get(s, i))
    root = {i: i for i in lead.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    different = list(lead.items())
    for k, (s, i) in enumerate(different):
        for t, j in different[:k]:
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    found = [(i, len(s), find(lead[s]) if i is not None and s else i) for i, s in sets]
    return sorted(((i, n, c, i == c) for i, n, c in found), key=repr)


def near_rows():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, ident = [], 10
    for _ in range(30):  # groups of copies with edits of growing share
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 40, 200)))]
        for _ in range(rng.choice((1, 2, 5))):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 4))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((ident, rng.choice((" ", "\n", "  ")).join(words)))
            ident += 1
    hot = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(150):  # one large group of near copies
        words = list(hot)
        words[rng.randrange(120)] = f"u{ident}"
        rows.append((ident, " ".join(words)))
        ident += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(50))  # shared by texts that are not alike
    for _ in range(40):
        rows.append((ident, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))))
        ident += 1
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "One two three"), (5, "one TWO  three"), (6, "one two"), (None, "one two three"),
             (7, "É a b c d e"), (8, "é a b c d e"), (9, "k " * 20_000), (9, "one two three"), (2000, "k " * 19_000)]
    return rows


def test_near_dedup_equals_brute_force(spark, frame):
    rows = near_rows()
    docs = frame([(i, t, "en", "s") for i, t in rows]).repartition(7)
    got = minhash_forest.near_dedup(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_near(rows)


def test_near_dedup_threshold_is_exact(frame):
    # 8 shingles against the same 8 and more: 6 of 8 shared is linked, 5 of 8 is not
    a = "a b c d e f g h i j k"  # 7 shingles
    b = "a b c d e f g h i j x"  # 6 shared of 8: 75 %
    c = "p q r s t u v w x y"    # 6 shingles
    d = "p q r s t u v w x z"    # 5 shared of 7: below
    got = {r.doc_id: r.component_id for r in minhash_forest.near_dedup(
        frame([(1, a, "", ""), (2, b, "", ""), (3, c, "", ""), (4, d, "", "")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_drop_near_copies_keeps_one_of_each_group(frame):
    text = " ".join(f"w{k}" for k in range(50))
    docs = frame([(3, text, "en", "a"), (2, text + " end", "de", "b"), (9, "other", "en", "a")])
    kept = minhash_forest.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 9]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, k) for k in range(501, 560)]
    links += [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def template_rows():
    """600 texts of one template that are not alike, and 60 that are like one of them only."""
    rng = random.Random(8)
    template = [f"t{k}" for k in range(160)]
    tails = [[f"m{rng.randrange(10**9)}" for _ in range(40)] for _ in range(600)]
    rows = [(10 + k, " ".join(template + tail)) for k, tail in enumerate(tails)]
    rows += [(5000 + k, " ".join(template + tails[7 * k][:14] + [f"x{rng.randrange(10**9)}" for _ in range(26)])) for k in range(60)]
    return rows


def test_members_of_a_crowded_region_that_link_to_one_row(spark, frame):
    rows = template_rows()
    want = brute_near(rows)
    assert sum(kept for *_, kept in want) == 600
    got = minhash_forest.near_dedup(frame([(i, t, "en", "s") for i, t in rows]).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_links_do_not_depend_on_what_is_common(spark, frame):
    rows = template_rows()[:200] + near_rows()
    docs = frame([(i, t, "en", "s") for i, t in rows]).repartition(5)
    want = brute_near(rows)
    for often in (2, 9):
        assert sorted((tuple(r) for r in minhash_forest.near_dedup(docs, often=often).collect()), key=repr) == want


def overlap_links(sets, comps):
    return {(a, b) for a in sets for b in sets if a < b and comps[a] != comps[b]
            and 7 * len(sets[a] & sets[b]) >= 3 * (len(sets[a]) + len(sets[b]))}


def joined(comps, links):
    root = {c: c for c in comps.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(comps[a]), find(comps[b])
        root[max(a, b)] = min(a, b)
    return {k: find(c) for k, c in comps.items()}


@pytest.mark.parametrize("seed", range(3))
def test_rare_links_join_what_all_pairs_join(spark, seed):
    """Sets made of shared passages, tails of their own and edits, most of them near the threshold."""
    rng = random.Random(seed)
    passages = [list(range(1000 * p, 1000 * p + rng.choice((20, 40, 60)))) for p in range(1, 5)]
    sets, fresh = {}, 10**6
    for k in range(220):
        own = set()
        for p in rng.sample(passages, rng.choice((1, 1, 2, 2, 3))):
            cut = rng.choice((0, 0, 0, 1, 3, 6))
            own |= set(p[cut:])
        if rng.random() < 0.3 and k:
            own |= set(rng.sample(sorted(sets[rng.randrange(k)]), 5))
        for _ in range(int(len(own) * rng.choice((0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5)))):
            own.add(fresh)
            fresh += 1
        sets[k] = own
    comps = {k: k for k in sets}
    for k in range(0, 220, 3):  # some are joined already, rightly or not
        comps[k] = comps[rng.randrange(k + 1)]
    items = spark.createDataFrame([(k, len(s), comps[k], sorted(s)) for k, s in sets.items()],
                                  "_id long, _n long, _comp long, _t array<long>")
    for often in (1, 4):
        got = {tuple(r) for r in rare_links(items, often).collect()}
        every = overlap_links(sets, {k: k for k in sets})
        assert {(min(p), max(p)) for p in got} <= every
        assert joined(comps, got) == joined(comps, overlap_links(sets, comps))


def test_pairs_grow_with_the_rows_of_a_template(spark):
    """Texts of one template that are not alike: what is looked at grows with them, not with their square."""
    def seen(n):
        rng = random.Random(2)
        rows = [(k, 196, k, sorted([*range(156), *(10**6 + 40 * k + t for t in range(40))])) for k in range(n)]
        rng.shuffle(rows)
        items = spark.createDataFrame(rows, "_id long, _n long, _comp long, _t array<long>")
        links, left = rare_links_module._level(items, 64)
        return links.count(), left.count(), left.select("_t").distinct().count()
    for n in (300, 600, 1200):
        assert seen(n) == (0, n, 1)  # no pair, and one class on the next level
