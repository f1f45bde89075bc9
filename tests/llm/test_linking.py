import random

from lexiloom.llm import linking


def union_find(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {(x, root(x)) for x in list(up)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_a string, doc_b string, pct int, doc_name string, root long")


def check(spark, pairs):
    rows = [(a, b, 60, "x", 1) for a, b in pairs]
    got = {tuple(r) for r in linking.groups(frame(spark, rows)).collect()}
    assert got == union_find(pairs)


def test_shapes(spark):
    """Ring, long path, star, tree, clique and pairs at once; names of any script; a column name that clashes."""
    name = lambda s, i: f"{s}{i:03d}"
    ring = [(name("ring", i), name("ring", (i + 1) % 17)) for i in range(17)]
    order = list(range(60))
    random.Random(3).shuffle(order)
    path = [(name("path", order[i]), name("path", order[i + 1])) for i in range(59)]
    star = [("hub", name("leaf", i)) for i in range(40)]
    tree = [(name("tree", i), name("tree", (i - 1) // 2)) for i in range(1, 31)]
    clique = [(name("q", i), name("q", j)) for i in range(6) for j in range(i)]
    rings = [("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("k3", "m1"), ("m1", "m2"), ("m2", "k9"), ("k9", "k8"), ("k8", "k7"), ("k7", "k9")]
    check(spark, ring + path + star + tree + clique + rings + [("é", "z"), ("\U0001f600", "ﬁ"), ("a", "b"), ("b", "a"), ("a", "b")])


def test_random_graphs(spark):
    rng = random.Random(5)
    pairs = []
    for g in range(6):
        n = rng.randint(5, 40)
        pairs += [(f"{g}-{rng.randrange(n):02d}", f"{g}-{rng.randrange(n):02d}") for _ in range(int(n * rng.choice([0.6, 0.9, 1.1, 2])))]
    pairs = [(a, b) for a, b in pairs if a != b]
    check(spark, pairs)


def test_rows_that_are_no_links(spark):
    rows = [("a", "a", 99, "", 1), (None, "b", 99, "", 1), ("c", None, 99, "", 1), ("d", "e", None, "", 1), ("f", "g", 59, "", 1)]
    assert linking.groups(frame(spark, rows)).collect() == []
    assert linking.groups(frame(spark, [])).collect() == []
    got = linking.groups(frame(spark, [("f", "g", 10, "", 1), ("g", "f", 60, "", 1), ("f", "f", 99, "", 1)])).collect()
    assert {tuple(r) for r in got} == {("f", "f"), ("g", "f")}


def test_strip_and_compress_until_nothing_is_left(spark):
    """A long caterpillar, a deep tree, a long path and rings need many rounds and no core; labels are exact."""
    rng = random.Random(11)
    name = lambda s, i: f"{s}{i:04d}"
    order = list(range(400))
    rng.shuffle(order)
    caterpillar = [(name("c", order[i]), name("c", order[i + 1])) for i in range(399)] + [(name("c", i), name(f"leg{j}-", i)) for i in range(0, 400, 3) for j in range(2)]
    tree = [(name("t", i), name("t", max(0, i - rng.randint(1, 3)))) for i in range(1, 300)]
    rings = [(name(f"r{k}-", i), name(f"r{k}-", (i + 1) % k)) for k in (3, 4, 64) for i in range(k)]
    check(spark, caterpillar + tree + rings)


def test_a_round_removes_an_independent_set(spark):
    """No removed vertex hangs on one that goes in the same round, and the groups stay what they were."""
    rng = random.Random(2)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(55)) if a != b}
    rows = linking._round(spark.createDataFrame(sorted(edges), "a long, b long"), 0).collect()
    hung = {r["a"]: r["b"] for r in rows if r["hung"]}
    left = [(r["a"], r["b"]) for r in rows if not r["hung"]]
    assert hung and not set(hung) & set(hung.values()) and not any(a in hung or b in hung for a, b in left)
    before, after = union_find(edges), dict(union_find(left + list(hung.items())))
    groups = lambda pairs: {frozenset(v for v, r in pairs if r == root) for root in {r for _, r in pairs}}
    assert groups(before) == groups(after.items())


def test_no_stored_table_is_left_behind(spark):
    """Superseded tables are deleted at once, the last ones with release()."""
    from lexiloom import session

    session.release()
    linking.groups(frame(spark, [("a", "b", 60, "x", 1), ("b", "c", 60, "x", 1)])).collect()
    here = session._stored[spark.sparkContext.applicationId]
    assert 0 < len(here) <= 4
    session.release()
    assert spark.sparkContext.applicationId not in session._stored
