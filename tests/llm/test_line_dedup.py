import hashlib
import random

import pytest

from panelcast.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders.setdefault(key_of(line), set()).add(i)
    keeper = {}
    for key, ids in holders.items():
        known = {i for i in ids if i is not None}
        if len(known) >= min_docs:
            keeper[key] = max(known)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def sample():
    rng = random.Random(4)
    shared = [f"Shared line {k} " + "abcde fghij " * 4 for k in range(30)]
    rows = []
    for i in range(300):
        lines = [rng.choice(shared[:1 + i % 30]) for _ in range(rng.randrange(6))] + [f"own line of {i} " + "z" * rng.randrange(60)]
        lines += ["", "  ", "short"] + ([shared[0].upper() + " \t"] if i % 3 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    edge = "e" * 40
    rows += [(1000 + k, edge if k else "  " + edge + "\r") for k in range(5)]           # exactly 40 and 5
    rows += [(1100 + k, "f" * 39) for k in range(9)] + [(1200 + k, "four " * 9) for k in range(4)]
    rows += [(1300 + k, "É" * 39 + "a\n" + "é" * 40) for k in range(6)]
    rows += [(None, None), (1400, None), (1401, ""), (1402, "\n\n"), (1403, "\n".join([edge] * 3)), (None, edge),
             (1404, "q\n" * 50_000), (1405, "w" * 200_000), (7, edge), (7, edge + "\nmore"), (1405, edge), (1405, edge)]
    return rows


@pytest.mark.parametrize("batches, winners", [(1, 2048), (3, 1), (7, 2048)])
def test_line_dedup_equals_brute_force(frame, batches, winners):
    rows = sample()
    docs = frame([(i, t, "en", "s") for i, t in rows]).repartition(5)
    got = line_dedup.line_dedup(docs, batches=batches, winners=winners).collect()
    found = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in got), key=repr)
    assert found == brute(rows)


def test_empty_table(frame):
    assert line_dedup.line_dedup(frame([])).collect() == []


def test_only_null_ids(frame):
    got = line_dedup.line_dedup(frame([(None, "x" * 50, "en", "s")] * 6)).collect()
    assert [(r.n_lines, r.n_dropped) for r in got] == [(1, 0)] * 6


def test_runs_are_levelled_and_settled_keys_are_left_out(spark):
    from panelcast.llm.common import remove_folder, scratch_folder
    folder = scratch_folder(spark, "runs-test")
    runs = line_dedup.LineRuns(spark, folder, settled=2)

    def batch(ids, hashes):
        return spark.createDataFrame([(i, h, h) for i in ids for h in hashes], "_id long, _h1 long, _h2 long")
    levels = []
    for k in range(5):
        runs.add(batch([100 - 10 * k, 99 - 10 * k], [1, 10 + k]))
        levels.append([level for _, level in runs.runs])
    assert levels == [[0], [1], [1, 0], [2], [2, 0]]
    found = {r._h1: (r._docs, r._keeper) for r in runs.repeated().collect()}
    assert found[1] == (2, 100)  # the later batches' counts of a settled key are not added
    assert found[14] == (2, 60) and len(found) == 6
    plan = runs._merge(spark.table(runs.runs[0][0]), spark.table(runs.runs[1][0]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()
    remove_folder(spark, folder)


def test_no_python_in_the_plan(frame):
    plan = line_dedup.line_dedup(frame([(1, "x", "en", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
