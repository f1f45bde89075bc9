"""Term statistics and pairwise scores over postings.

Units (texts, sentences, chunks) become postings (unit, term, tf). Two units that share no term score 0 in every measure
here, so an equi-join on the term finds all pairs that matter. With two units A and B the inverse document frequency takes
two values only (1 for shared terms, C for others); the cosine then needs three sums over shared terms and one number per
unit, and no outer join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import blocks as B
from lexiloom.session import drop, stored

C = math.log(1.5) + 1
K1, LENGTH = 1.5, 0.75


def term_frequency(documents: DataFrame) -> DataFrame:
    """doc_id, term, cnt, tf of every content token; documents without any have no row."""
    with_size = T.let(T.tokens_content("text"), lambda t: F.transform(t, lambda x: F.struct(x.alias("term"), F.size(t).alias("n"))))
    each = documents.select("doc_id", F.explode(with_size).alias("e")).select("doc_id", "e.*")
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("cnt"), F.first("n").alias("n")).select("doc_id", "term", "cnt", (F.col("cnt") / F.col("n")).alias("tf"))


def document_frequency(documents: DataFrame) -> DataFrame:
    """term, df: in how many documents a content token occurs. Distinct within the row first, so that one count per document
    and term is exchanged, combined before it is."""
    return documents.select(F.explode(F.array_distinct(T.tokens_content("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def tfidf(documents: DataFrame) -> DataFrame:
    """doc_id, term, weight = tf (ln((N + 1) / (df + 1)) + 1). The texts are read and cut into tokens once: document frequencies
    are counted from the term frequencies; N is a scalar inside the plan."""
    tf = term_frequency(documents)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = documents.agg(F.count("*").alias("n")).scalar()
    return tf.join(df, "term").select("doc_id", "term", (F.col("tf") * (F.log((n + 1).cast("double") / (F.col("df") + 1)) + 1)).alias("weight"))


def tfidf_top(documents: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, rank, term, weight of the k heaviest terms of each document; ties by term."""
    by = Window.partitionBy("doc_id").orderBy(F.desc("w"), "term")
    return tfidf(documents).withColumn("w", T.rounded(F.col("weight"), 9)).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("doc_id", F.col("rank").cast("long").alias("rank"), "term", T.rounded(F.col("w"), 6).alias("weight"))


def corpus_cosine(documents: DataFrame, every: int = 20) -> DataFrame:
    """doc_id, links, best_id, best_sim: of each document whose id is divisible by `every`, its corpus TF-IDF cosine with all
    others: how many are above 0 (rounded to 4 digits), and the nearest (ties: smallest id). Rows of one doc_id are one document.

    A pair that shares a term is one of many (about 85 percent of all pairs), and each of them counts; so they are added up
    by blocks of postings and never stored. Terms are 64-bit hashes; those of one document only count for its norm.
    """
    count = documents.count()
    hashed = documents.filter("doc_id is not null").select("doc_id", F.transform(T.tokens_content("text"), lambda t: F.xxhash64(t)).alias("h")).filter(F.size("h") > 0)
    parted = hashed.repartition(B.parts(documents, count), "doc_id").sortWithinPartitions("doc_id")
    vectors = stored(parted.mapInArrow(B.term_counts, "doc_id long, n int, terms array<bigint>, counts array<int>"))
    shared = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter("df > 1").toArrow()
    idf = lambda df: np.log((count + 1.0) / (df + 1)) + 1
    terms = shared.column("term").to_numpy()
    order = np.argsort(terms)
    known = documents.sparkSession.sparkContext.broadcast((terms[order], idf(shared.column("df").to_numpy()[order]), idf(1.0)))
    blocks = stored(vectors.mapInArrow(lambda stream: B.weighted_blocks(stream, *known.value, every), "d array<binary>, q array<binary>"))
    drop(vectors)
    sims = B.met(blocks, B.open_weighted, B.nearest_by_weight, "q long, links long, sim double, doc_id long")
    best = sims.groupBy("q").agg(F.sum("links").alias("links"), F.min(F.struct((-F.col("sim")).alias("s"), F.col("doc_id"))).alias("b"))
    return best.select(F.col("q").alias("doc_id"), "links", F.col("b.doc_id").alias("best_id"), (-F.col("b.s")).alias("best_sim"))


def postings(units: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """keys, term, tf (count), n (tokens), u (distinct), sq (sum of squared relative frequencies) of each unit's terms."""
    made = units.select(*keys, tokens.alias("tokens"))
    made = made.select(*keys, "tokens", F.size("tokens").alias("n"), F.size(F.array_distinct("tokens")).alias("u"), T.total(F.transform(T.counts(F.col("tokens")), lambda c: (c * c).cast("double"))).alias("ss"))
    each = made.select(*keys, "n", "u", (F.col("ss") / (F.col("n") * F.col("n"))).alias("sq"), F.explode("tokens").alias("term"))
    return each.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"), F.first("u").alias("u"), F.first("sq").alias("sq"))


def scores(a: DataFrame, b: DataFrame, on: list[str], key_a: list[str], key_b: list[str]) -> DataFrame:
    """on, key_a, key_b, cosine, bm25 of all pairs of units that share a term within `on`.

    cosine: TF-IDF of the two units alone, at most 1. bm25: mean of both directions, each divided by three times the number
    of distinct query terms and at most 1.
    """
    left = a.select(*on, *key_a, "term", *[F.col(c).alias(f"{c}_a") for c in ("tf", "n", "u", "sq")])
    right = b.select(*on, *key_b, "term", *[F.col(c).alias(f"{c}_b") for c in ("tf", "n", "u", "sq")])
    ra, rb = F.col("tf_a") / F.col("n_a"), F.col("tf_b") / F.col("n_b")
    mean = (F.col("n_a") + F.col("n_b")) / 2

    def part(tf: str, n: str) -> Column:
        f, size = F.col(tf), F.col(n)
        return F.log(1 + 1 / (f / size + 0.001)) * (f * (K1 + 1)) / (f + K1 * (1 - LENGTH + LENGTH * (size / mean)))

    sums = left.join(right, [*on, "term"]).groupBy(*on, *key_a, *key_b).agg(
        F.sum(ra * rb).alias("dot"), F.sum(ra * ra).alias("sa"), F.sum(rb * rb).alias("sb"), F.sum(part("tf_b", "n_b")).alias("ab"), F.sum(part("tf_a", "n_a")).alias("ba"),
        *[F.first(c).alias(c) for c in ("u_a", "u_b", "sq_a", "sq_b")])
    norm = F.sqrt(C * C * F.col("sq_a") - (C * C - 1) * F.col("sa")) * F.sqrt(C * C * F.col("sq_b") - (C * C - 1) * F.col("sb"))
    one = F.lit(1.0)
    return sums.select(*on, *key_a, *key_b, F.least(F.col("dot") / norm, one).alias("cosine"), ((F.least(F.col("ab") / (F.col("u_a") * 3), one) + F.least(F.col("ba") / (F.col("u_b") * 3), one)) / 2).alias("bm25"))
