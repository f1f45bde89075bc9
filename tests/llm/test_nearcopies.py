import random

import numpy as np

from lexiloom.llm import nearcopies

SCHEMA = "doc_id long, text string, cls long, key string"


def brute(rows, shingle=12, least=200, threshold=0.5):
    forms = {k: "".join(c for c in (t or "").lower() if c.isalpha() or c.isnumeric()) for k, t, *_ in rows}
    sets = {k: {f[i : i + shingle] for i in range(len(f) - shingle + 1)} for k, f in forms.items() if len(f) >= least}
    ids = sorted(sets)
    return {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=1, families=8, size=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows = []
    for f in range(families):
        words = [word() for _ in range(120)]
        for e in range(size):
            mine = list(words)
            for _ in range(2 * e * (f % 3)):
                mine[rng.randrange(len(mine))] = word()
            if e == 3:
                mine = mine[60:] + mine[:60]
            rows.append((f * 100 + e, " ".join(mine), 1, "x"))
    return rows


def edge_rows():
    long = "ab" * 5000
    return [(9001, None, 1, "x"), (9002, "", 1, "x"), (9003, "short", 1, None), (9004, "!?" * 300, 1, "x"), (9005, long, 1, "x"), (9006, long.upper() + " .", 1, "x"), (9005, long, 1, "x"), (9007, "é" * 199, 1, "x"), (9008, "é" * 200, 1, "x"), (9009, "é" * 200, 1, "x")]


def test_pairs_against_brute_force(spark):
    rows = corpus() + edge_rows()
    got = [tuple(r) for r in nearcopies.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert (9005, 9006) in got and (9008, 9009) in got


def test_hot_buckets_lose_nothing(spark):
    """With a bucket limit of 3 and blocks of 4 nearly all candidates go through block pairs."""
    rows = corpus(2, 4, 20)
    got = {tuple(r) for r in nearcopies.near_pairs(spark.createDataFrame(rows, SCHEMA), hot=3, block=4).collect()}
    assert got == brute(rows)


def test_groups_have_every_long_record(spark):
    rows = corpus() + edge_rows()
    got = {r["doc_id"]: r for r in nearcopies.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    pairs = brute(rows)
    assert set(got) == {k for k, t, *_ in rows if sum(c.isalnum() for c in t or "") >= 200}
    for a, b in pairs:
        assert got[a]["group_id"] == got[b]["group_id"]
    assert got[9006]["class_id"] == 9005 and got[9005]["links"] == 0


def test_empty(spark):
    assert nearcopies.near_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    assert nearcopies.near_pairs(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect() == []


def test_pruning_keeps_the_threshold():
    """The limits drop what is far below the threshold and keep what reaches it."""
    limits = nearcopies.least_matches(0.5)
    assert all(m < 0.5 * n for m, n in zip(limits, range(16, 97, 16))) and limits[-1] > 0.3 * 96


def test_candidates_far_below_the_threshold_are_never_stored(spark, monkeypatch):
    """Records that share a seventh of their text meet under many keys; what is stored of their pairs is next to nothing."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    common = [word() for _ in range(40)]
    rows = [(i, " ".join(common + [word() for _ in range(120)]), 1, "x") for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " " + word(), 1, "x") for i in range(5)]
    pairs = set()

    def counted(df):
        out = stored(df)
        if df.columns == ["a", "b", "key"]:
            pairs.update((r["a"], r["b"]) for r in out.filter("b is not null").collect())
        return out

    stored = nearcopies.stored
    monkeypatch.setattr(nearcopies, "stored", counted)
    got = {tuple(r) for r in nearcopies.near_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, 1000 + i) for i in range(5)}
    assert 5 <= len(pairs) < 100


def test_pairs_in_runs_and_blocks():
    """The same pairs as one by one, whatever the steps."""
    rng, limits = np.random.default_rng(3), nearcopies.least_matches()
    sketch = rng.integers(0, 256, (90, nearcopies.SKETCH), dtype=np.uint8)
    for k in range(0, 88, 2):
        sketch[k + 1] = np.where(rng.random(nearcopies.SKETCH) < k / 88, sketch[k], sketch[k + 1])
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if len(nearcopies.survivors(sketch[i : i + 1], sketch[j : j + 1], limits))}
    assert len(want) > 20
    for step in (100, 1_000_000):
        nearcopies.STEP_PAIRS, before = step, nearcopies.STEP_PAIRS
        try:
            assert set(zip(*(x.tolist() for x in nearcopies.alike(sketch, None, limits)))) == want
            across = {(int(i), int(j) + 41) for i, j in zip(*nearcopies.alike(sketch[:41], sketch[41:], limits))}
        finally:
            nearcopies.STEP_PAIRS = before
        assert across == {(i, j) for i, j in want if i < 41 <= j}
    run, i, j = nearcopies.alike_each(sketch.reshape(9, 10, -1), limits)
    assert set(zip((run * 10 + i).tolist(), (run * 10 + j).tolist())) == {(i, j) for i, j in want if i // 10 == j // 10}
    assert [len(x) for x in nearcopies.alike(sketch[:0], None, limits) + nearcopies.alike(sketch, sketch[:0], limits)] == [0] * 4
