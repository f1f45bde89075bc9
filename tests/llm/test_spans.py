import random

import numpy as np
import pytest

from lexiloom.llm import spans

SCHEMA = "doc_id long, text string, start_pos long, hash string"


def brute(rows, span):
    """Runs of shared characters per doc_id, by comparing all stretches of the texts of different ids."""
    where = {}
    for k, t, *_ in rows:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(k)
    hit = {}
    for k, t, *_ in rows:
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit.setdefault(k, set()).update(range(i, i + span))
    out = set()
    for k, places in hit.items():
        for p in places:
            if p - 1 not in places:
                e = p
                while e in places:
                    e += 1
                out.add((k, p, e))
    return out


def rows_of(seed, n, letters="ab \n", blocks=6):
    rng = random.Random(seed)
    make = lambda m: "".join(rng.choice(letters) for _ in range(m))
    block = [make(rng.randint(10, 90)) for _ in range(blocks)]
    rows = []
    for k in range(n):
        text = "".join(make(rng.randint(0, 30)) + (b := rng.choice(block))[rng.randint(0, 5) : len(b) - rng.randint(0, 5)] for _ in range(rng.randint(0, 6)))
        rows.append((k, text, 1, "x"))
    return rows + [(900, None, 1, None), (901, "", 1, ""), (902, rows[0][1], 1, ""), (0, rows[0][1], 1, ""), (903, "é" * 300, 1, ""), (904, "é" * 120, 1, ""), (905, "z" * 300, 1, "")]


@pytest.mark.parametrize("options", [{}, {"shard_passages": 2}, {"shard_chars": 300}, {"shard_chars": 40, "shard_passages": 1}])
def test_runs_against_brute_force(spark, options):
    for seed, letters in ((1, "ab \n"), (2, "abcdefghijklmnop é"), (3, "a")):
        rows = rows_of(seed, 40, letters)
        got = [tuple(r) for r in spans.shared_runs(spark.createDataFrame(rows, SCHEMA), span=20, passage=8, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 20)


def test_share(spark):
    block = "".join(chr(97 + i * i % 26) for i in range(250))
    rows = [(1, "x" + block + "y", 0, ""), (2, block, 0, ""), (3, "alone " * 3, 0, ""), (4, None, 0, ""), (5, "", 0, ""), (3, "alone " * 3, 0, "")]
    got = sorted((r["doc_id"], r["shared_chars"], r["runs"], round(r["shared_share"], 6)) for r in spans.shared_share(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 250, 1, round(250 / 252, 6)), (2, 250, 1, 1.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 0, 0, 0.0), (5, 0, 0, 0.0)]
    assert spans.shared_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_hits_of_the_automaton_decide(monkeypatch):
    """The places come from the automaton: without its hits nothing is found."""
    block = "".join(chr(0x4E00 + i) for i in range(60))
    texts = [(1, "q" * 30 + block + "r" * 9), (2, block + "s" * 40)]

    def run(phrases):
        shard = spans.Shard(20)
        shard.phrases = phrases
        for k, t in texts:
            shard.add(k, t)
        got = shard.found(True)
        return {tuple(r.values()) for b in got for r in b.select(["doc_id", "start_pos", "end_pos"]).to_pylist()}

    assert run([block[i : i + 8] for i in range(0, 53, 4)]) == {(1, 30, 90), (2, 0, 60)}
    assert run([block[20:28]]) == {(1, 38, 70), (2, 8, 40)}  # only stretches around the hits
    assert run([block[10:50]]) == {(1, 40, 80), (2, 10, 50)}  # a phrase longer than a stretch
    assert run(["zzzzzzzz"]) == set() and run([]) == set()
    monkeypatch.setattr(spans, "occurrences", lambda made, text: (np.empty(0, np.int64),) * 2)
    assert run([block[i : i + 8] for i in range(0, 53, 4)]) == set()


def test_recorded_sentences(spark):
    """Recorded matches are looked for as well; they add no row that isn't shared."""
    rows = rows_of(4, 30)
    recorded = [(k, k + 1, rows[k][1][3:30], 0.5) for k in range(20)] + [(None, 1, "a b a b a b", 0.5), (1, None, "b", 0.5), (77, 78, "ab ab ab ab", None), (2, 3, None, None)]
    known = spark.createDataFrame(recorded, "doc_id long, other_id long, sentence_a string, text double")
    got = {tuple(r) for r in spans.shared_runs(spark.createDataFrame(rows, SCHEMA), known, span=20, passage=8).collect()}
    assert got == brute(rows, 20)
