import random

import numpy as np
import pytest

from lexiloom.llm import codes, encoding, packing, repetition

SCHEMA = "doc_id long, text string, tokens long, ids string"
TRICKY = ["'re", "'", " ", "  ", "\n", "a", "word", "s", "ll", "9", "é", "的", "!", "-", "ไ", "\t", "\xa0", "😀", "\n\n ", "<|endoftext|>"]


@pytest.mark.parametrize("leaf", [2, 3, 7, 50])
def test_tree_equals_direct_encoding(leaf):
    code = encoding.TreeEncoder(encoding.vocabulary(), leaf)
    rng = random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(TRICKY) for _ in range(rng.randint(0, 60)))
        assert code.encode(text) == code.coder.encode_ordinary(text)
        assert code.decode(code.encode(text)) == text


def test_ids_of_all_rows(spark):
    texts = [None, "", " ", "Hello world", "Hello world", "a" * 20000, "x y\n" * 5000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in enumerate(texts)] + [(3, "Hello world", 1, None)], SCHEMA)
    got = encoding.token_ids(df).collect()
    assert len(got) == len(texts) + 1
    code = encoding.encoder(encoding.vocabulary())
    assert all(r["ids"] == (code.coder.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else []) for r in got)
    assert sorted((r["doc_id"], r["tokens"]) for r in encoding.token_counts(df).collect()) == sorted((r["doc_id"], len(r["ids"])) for r in got)
    assert encoding.token_ids(df.limit(0)).collect() == []


def naive_squares(sizes, capacity):
    """Sum-of-squares packing by trying every open container."""
    gaps = []
    for s in sizes:
        count = {}
        for g in gaps:
            if 0 < g < capacity:
                count[g] = count.get(g, 0) + 1
        best = None
        for g in sorted({g for g in gaps if g >= s and g > 0}) + [capacity]:
            new = dict(count)
            if g < capacity:
                new[g] -= 1
            if 0 < g - s < capacity:
                new[g - s] = new.get(g - s, 0) + 1
            total = sum(x * x for x in new.values())
            if best is None or total < best[0]:
                best = (total, g)
        if best[1] == capacity and capacity not in gaps:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(best[1])] -= s
    return len(gaps), sorted(gaps)


def test_packing_follows_the_rule():
    rng = random.Random(4)
    for _ in range(20):
        cap = rng.randint(3, 20)
        sizes = sorted((rng.randint(1, cap) for _ in range(40)), reverse=True)
        rows, n = packing.pack(np.arange(40), np.array(sizes), cap)
        used = {}
        for _, _, a, b, c in rows:
            used[c] = used.get(c, 0) + b - a
        assert (n, sorted(cap - u for u in used.values())) == naive_squares(sizes, cap)


def test_packed_rows(spark):
    rng = random.Random(6)
    counts = [(i, rng.choice([0, 1, 7, 30, 100, 101, 950])) for i in range(300)] + [(5, 3)]
    df = spark.createDataFrame([(i, n, "x") for i, n in counts], "doc_id long, tokens long, container string")
    limits = spark.createDataFrame([("s", 100), ("s", 100), ("l", 1000), (None, 5), ("bad", 0)], "limit_name string, capacity int")
    rows = packing.packed(df, limits, group_items=50).collect()
    want = {}
    for i, n in counts:
        want[i] = max(want.get(i, 0), n)
    for name, cap in (("s", 100), ("l", 1000)):
        mine = [r for r in rows if r["limit_name"] == name]
        load, by = {}, {}
        for r in mine:
            by.setdefault(r["doc_id"], []).append(r)
            if r["container"] is not None:
                load[r["container"]] = load.get(r["container"], 0) + r["end_token"] - r["start_token"]
        assert max(load.values()) <= cap and set(by) == set(want)
        for i, n in want.items():
            parts = sorted(by[i], key=lambda r: r["piece"])
            assert len(parts) == max(1, -(-n // cap)) and parts[-1]["end_token"] == n
            assert all(p["start_token"] == q["end_token"] for p, q in zip(parts[1:], parts))
    assert {r["limit_name"] for r in rows} == {"s", "l"}
    assert packing.packed(df.limit(0), limits).collect() == []


def brute_repeats(c, k):
    seen, hit = set(), set()
    for i in range(len(c) - k + 1):
        g = tuple(c[i : i + k])
        if g in seen:
            hit.update(range(i, i + k))
        seen.add(g)
    best = next((m for m in range(len(c) - 1, k - 1, -1) if len({tuple(c[i : i + m]) for i in range(len(c) - m + 1)}) < len(c) - m + 1), 0)
    return len(hit), best


def test_repeats_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        parts = [np.array([rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))], dtype=np.uint32) for _ in range(6)]
        covered, longest = repetition.repeats(parts, 5)
        assert [(a, b) for a, b in zip(covered, longest)] == [brute_repeats(p.tolist(), 5) for p in parts]


def test_repetition_rows(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "Same words, here. " * 30), (5, "abc" * 20000), (6, "one two three four five six seven"), (7, "é" * 21)]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows] + [(4, "Same words, here. " * 30, 0, None)], SCHEMA)
    got = {r["doc_id"]: r for r in repetition.repetition(df).collect()}
    assert got[1]["norm_chars"] == got[2]["norm_chars"] == got[3]["norm_chars"] == 0 and got[6]["repeated_share"] == 0
    assert got[4]["longest_repeat"] == 29 * 13 and got[5]["repeated_share"] == (60000 - 3) / 60000 and got[7]["repeated_chars"] == 20
    assert sorted(r["doc_id"] for r in repetition.repetitive(df).collect()) == [4, 4, 5, 7]
    assert sorted(r["doc_id"] for r in repetition.repetitive(df, min_share=2, min_longest=1000).collect()) == [5]
    assert repetition.repetition(df.limit(0)).collect() == []


def test_rolling_hashes():
    a = np.random.default_rng(0).integers(0, 3, 500).astype(np.uint32)
    for k in (1, 2, 5, 12, 200):
        h = codes.rolling(a, k)
        strings = {}
        for i, x in enumerate(h):
            assert strings.setdefault(tuple(a[i : i + k]), x) == x
        assert len(h) == 501 - k and len(set(strings.values())) == len(strings)
