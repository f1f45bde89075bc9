"""Scores of queries with all documents by blocks: nothing is joined per pair, and several blocks give what all pairs give."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from lexiloom.operators import blocks, pairs, postings, sketch
from lexiloom.plans import oracles

WORDS = ["loom", "mill", "river", "clerk", "stone", "apple", "ledger", "bridge", "winter", "harbour"]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corpus_cosine_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 20)
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(WORDS[: rng.randint(3, 10)]) for _ in range(rng.randint(1, 12))) for i in range(0, 130)} | {140: "nowhere else", 160: "", 180: None, -20: "loom mill"}
    texts[120] = texts[7]
    rows = [*texts.items(), (40, texts[40]), (None, "loom river"), (20, "")]  # a repeated row counts twice
    assert blocks.parts(docs(spark, rows), len(rows)) == 7
    got = postings.corpus_cosine(docs(spark, rows))
    assert "Join" not in plan(got)
    count = {i: Counter({t: n * (1 + (i == 40)) for t, n in Counter((t or "").split()).items()}) for i, t in texts.items()}
    df = Counter(w for c in count.values() for w in c)
    vectors = {i: {w: n / len(texts[i].split()) * (math.log((len(rows) + 1) / (df[w] + 1)) + 1) for w, n in c.items()} for i, c in count.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    want = {}
    for q in (i for i in texts if i % 20 == 0):
        dots = {o: sum(x * vectors[o].get(w, 0) for w, x in vectors[q].items()) for o in texts if o != q}
        sims = {o: math.floor(min(s / (norm[q] * norm[o]), 1) * 1e4 + 0.5) / 1e4 for o, s in dots.items() if s}
        if sims:
            best = min(sims, key=lambda o: (-sims[o], o))
            want[q] = (len(sims), best, sims[best])
    assert {r["doc_id"]: (r["links"], r["best_id"], r["best_sim"]) for r in got.collect()} == want and 140 not in want


def by_sql(name, rows):
    db = duckdb.connect()
    db.sql("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    return sorted(db.sql(oracles.oracle_sql()[name]).fetchall(), key=str)


def test_cross_document_links_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 20)
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["the", "of", "it", *WORDS, *(f"word{k}" for k in range(40))][: rng.randint(4, 53)]) for _ in range(rng.randint(0, 60))) for i in range(0, 130)}
    for i in range(0, 130, 9):  # copied in part
        texts[i] = " ".join(texts[i].split()[:20] + texts[(i * 7 + 20) % 120].split()[5:])
    texts |= {131: texts[40], 140: "nowhere else", 160: "", 180: None, 200: "of the it of", 201: "of the it of"}
    rows = [*texts.items(), (40, texts[40]), (7, texts[7]), (7, texts[7]), (None, texts[40])]
    got = pairs.cross_document_links(docs(spark, rows))
    assert plan(got).count("Join") == 1  # of the queries with what was found
    assert sorted(map(tuple, got.collect()), key=str) == by_sql("cross_document_links", rows)


def test_minhash_matrix_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST", 20)
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(WORDS[: rng.randint(2, 10)]) for _ in range(rng.randint(0, 40))) for i in range(0, 130)}
    texts |= {131: texts[40], 133: texts[40], 60: texts[20], 19: texts[20], 140: "nowhere else at all", 160: "", 180: None, 200: "one", 211: ""}
    rows = [*texts.items(), (40, texts[40])]
    got = sketch.minhash_matrix(docs(spark, rows))
    assert "Join" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == by_sql("minhash_matrix", rows)


def test_minhashes_of_many_texts():
    """The remainders by halves are those of fmod in double arithmetic."""
    rng = random.Random(6)
    texts = [[f"w{rng.randint(0, 10**6)} {'x' * rng.randint(0, 9)}{k}" for k in range(n)] for n in [0, 3, 0, 700, 1, 511, 512, 513, 0, *(rng.randint(0, 90) for _ in range(40)), 0]]
    a, b = sketch.permutations()
    flat = [g for t in texts for g in t]
    x = sketch.mixed32_of(pa.array(flat, pa.string()))
    assert (x == sketch.mixed32(flat)).all() and (sketch.mixed32_of(pa.array(flat).slice(5, 9)) == x[5:14]).all()
    got = sketch.minhashes(x, np.append(0, np.cumsum([len(t) for t in texts])))
    for t, row in zip(texts, got):
        h = sketch.mixed32(t).astype(np.float64)
        assert (row == (np.fmod(a[:, None] * h + b[:, None], sketch.PRIME).min(axis=1) if t else 0)).all()
