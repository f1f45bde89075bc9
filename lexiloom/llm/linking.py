"""Problem 6: one group for all names that are linked directly or through others.

Vertices are 64-bit hashes of the names (a collision, found by one aggregation, makes the work start over with another seed).
The graph is reduced before it is solved; one round of the reduction

1. strips vertices of degree one: each hangs on its only neighbour;
2. compresses chains of degree-two vertices by list ranking with independent sets (Anderson and Miller): a chain vertex whose
   random priority is the smallest among its neighbours in the chain is spliced out, its two neighbours become linked, and it
   hangs on one of them. A third of a chain goes in each round, so that all rounds together cost in proportion to its length;

and rounds go on until neither removes a vertex: then every vertex has three neighbours or more. That core is solved by
alternating large-star and small-star steps, and labels go back to the removed vertices along the ones they hang on, by
pointer doubling: what a vertex hangs on was removed in a later round, if at all.

A round is four aggregations in turn on vertices and on edges, all combined before the exchange, and no join: a hub costs no
task more than another vertex. It is one write; what it removed is counted in passing. Nothing is gathered in one task or the
driver but counts. Every round's table lies in the checkpoint folder, so that a lost executor costs no more than the round;
it is deleted as soon as the next one is there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexiloom.session import apart, drop, moved, stored

#: A link needs at least this pct.
MIN_PCT = 60
#: Edges of a partition in a round of the reduction.
PARTITION_EDGES = 500_000
#: Seeds tried before collisions of names' hashes are given up on (two in a row are as good as impossible).
SEEDS = 8


def links(pairs: DataFrame, min_pct: int = MIN_PCT) -> DataFrame:
    """doc_a < doc_b: the links of pair rows, repeated ones too; rows with a null name or pct, a small pct or equal names are
    none."""
    a, b = F.col("doc_a"), F.col("doc_b")
    return pairs.filter((F.col("pct") >= min_pct) & (a != b)).select(F.least(a, b).alias("doc_a"), F.greatest(a, b).alias("doc_b"))


def _edge(u: Column, v: Column) -> tuple[Column, Column]:
    return F.least(u, v).alias("a"), F.greatest(u, v).alias("b")


def _ends(edges: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """u, v: every edge in both directions, by one pass; further columns are named by (column at a, column at b)."""
    side = lambda k: [F.col("ab"[k]).alias("u"), F.col("ba"[k]).alias("v"), *(F.col(c[k]).alias(n) for n, c in columns.items())]
    return edges.select(F.explode(F.array(F.struct(*side(0)), F.struct(*side(1)))).alias("e")).select("e.*")


def _counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """The stored rows, and aggregates of them taken while they were written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
    return out, seen.get


def _round(edges: DataFrame, turn: int) -> DataFrame:
    """hung, a, b: the edges that are left (hung false) and the removed vertices a with what they hang on, b (hung true)."""
    low = _ends(edges).groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("d <= 2")
    # edges with the degree of either end: 1, 2 or, for all others, 0
    near = low.select("u", "d", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("v"))
    at = lambda end: F.when(F.col("u") == F.col(end), F.col("d")).otherwise(0)
    told = near.select("u", "d", *_edge(F.col("u"), F.col("v"))).select("a", "b", at("a").alias("da"), at("b").alias("db"))
    none = F.lit(0).cast("long")
    known = edges.select("a", "b", none.alias("da"), none.alias("db")).union(told).groupBy("a", "b").agg(F.max("da").alias("da"), F.max("db").alias("db"))
    # a vertex of degree one or two sees all its neighbours
    seen = _ends(known, du=("da", "db"), dv=("db", "da")).filter("du > 0")
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)), c)
    ahead = (F.col("dv") == 2) & (rank(F.col("v")) < rank(F.col("u")))
    seen = seen.groupBy("u").agg(F.max("du").alias("d"), F.min("v").alias("v1"), F.max("v").alias("v2"), F.max((F.col("dv") == 1).cast("int")).alias("leaf"), F.max(ahead.cast("int")).alias("behind"))
    strip = (F.col("d") == 1) & ((F.col("leaf") == 0) | (F.col("u") > F.col("v1")))  # of two leaves the smaller stays
    splice = (F.col("d") == 2) & (F.col("leaf") == 0) & (F.col("behind") == 0)
    gone = seen.filter(strip | splice)
    lost = gone.select("u", F.explode(F.array_distinct(F.array("v1", "v2"))).alias("v")).select(*_edge(F.col("u"), F.col("v")), F.lit(1).alias("lost"))
    joined = gone.filter("d = 2").select(*_edge(F.col("v1"), F.col("v2")), F.lit(0).alias("lost"))
    left = known.select("a", "b", F.lit(0).alias("lost")).union(lost).union(joined).groupBy("a", "b").agg(F.max("lost").alias("lost")).filter("lost = 0")
    return left.select(F.lit(False).alias("hung"), "a", "b").union(gone.select(F.lit(True), "u", "v1"))


def _solve(edges: DataFrame) -> DataFrame:
    """a, b: the smallest vertex a of the group of each other vertex b, by alternating stars."""
    stars, before = edges, None
    while True:
        low = _ends(stars).groupBy("u").agg(F.min("v").alias("m"))
        # large star: every larger neighbour is linked to the smallest one
        large = _ends(stars).filter("v > u").join(low, "u").select(F.col("v").alias("b"), F.least("u", "m").alias("a"))
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        pair = lambda b: F.struct(F.col("m").alias("a"), F.col(b).alias("b"))
        small = large.join(least, "b").select(F.explode(F.array(pair("a"), pair("b"))).alias("e")).select("e.a", "e.b").filter("a < b").distinct()
        after, seen = _counted(small, n=F.count("*"), rows=F.bit_xor(F.xxhash64("a", "b")))
        drop(stars)
        if seen == before:
            return after
        stars, before = after, seen


def labels(edges: DataFrame) -> DataFrame:
    """v, root of every vertex of `edges` (a, b: a < b, distinct, non-null longs); one root for each group, any of its
    vertices. Stored."""
    spark = edges.sparkSession
    # rounds have no join, and their partitions are sized by the edges counted in the round before: nothing is left to adapt
    quiet, joins = apart(spark, adaptive_enabled=False), apart(spark, adaptive_enabled=True, autoBroadcastJoinThreshold=-1)
    rest = first = moved(edges, quiet)
    rounds, left = [], rest.count()
    while left:
        quiet.conf.set("spark.sql.shuffle.partitions", -(-left // PARTITION_EDGES))
        made, n = _counted(_round(rest, len(rounds)), hung=F.expr("count_if(hung)"), left=F.expr("count_if(not hung)"))
        rounds.append(made)
        rest, left = made.filter("not hung").select("a", "b"), n["left"]
        if not n["hung"]:
            break
    up = [moved(r, joins).filter("hung").select(F.col("a").alias("v"), F.col("b").alias("p")) for r in rounds]
    if left:
        core = _solve(moved(made, joins).filter("not hung").select("a", "b"))
        rounds.append(core)
        up.append(core.select(F.col("b").alias("v"), F.col("a").alias("p")))
    depth, up = len(up), reduce(DataFrame.union, up, first.limit(0).toDF("v", "p"))
    while depth > 1:
        # pointers to the same vertex may be many: adaptive plans split them
        over = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        up, old = stored(up.join(over, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))), rounds
        drop(*old)
        rounds, depth = [up], (depth + 1) // 2
    found = moved(up, spark)
    return found.select("v", F.col("p").alias("root")).union(found.select("p", "p").distinct())


def components(edges: DataFrame) -> DataFrame:
    """v, root of every vertex of `edges` (a, b: distinct, a < b, non-null longs); root is the smallest vertex of the group."""
    found = labels(edges)
    smallest = found.groupBy("root").agg(F.min("v").alias("least"))
    return found.join(smallest, "root").select("v", F.col("least").alias("root"))


def groups(pairs: DataFrame, min_pct: int = MIN_PCT) -> DataFrame:
    """doc_name, group_name: every name with a link, and the smallest name (by code points) of its group.

    Self-links, null names, null or small pct make no link; repeated rows and both orders count once. No links: no rows.
    """
    for seed in range(SEEDS):
        code = lambda c: F.xxhash64(c, F.lit(seed))
        found = links(pairs, min_pct)
        ends = found.select(F.explode(F.array("doc_a", "doc_b")).alias("name")).groupBy(code("name").alias("v")).agg(F.min("name").alias("doc_name"), F.max("name").alias("other"))
        names, seen = _counted(ends, clashes=F.expr("count_if(doc_name <> other)"))
        if not seen["clashes"]:
            break
        drop(names)
    else:
        raise RuntimeError("the hashes of names clash for every seed")
    edges = stored(found.select(*_edge(code("doc_a"), code("doc_b"))).distinct())
    named = labels(edges).join(names, "v").select("doc_name", "root")
    least = named.groupBy("root").agg(F.min("doc_name").alias("group_name"))
    return named.join(least, "root").select("doc_name", "group_name")
