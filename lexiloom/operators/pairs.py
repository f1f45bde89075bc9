"""Similarity of a submission with a reference text, and of documents with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import blocks as B
from lexiloom.operators import postings as P
from lexiloom.session import cores, stored

WEIGHTS = {"cosine": 0.30, "bm25": 0.25, "bigram": 0.18, "trigram": 0.17, "fourgram": 0.10}


def checks(single_checks: DataFrame) -> DataFrame:
    """check_id, a, b: one row per check_id (a repeated row counts once; of different ones the smallest); null texts are empty."""
    one = single_checks.groupBy("check_id").agg(F.min(F.struct(T.text_of("submission").alias("a"), T.text_of("reference").alias("b"))).alias("s"))
    return one.select("check_id", "s.a", "s.b")


def containment(a: Column, b: Column) -> Column:
    """Share of a's distinct grams that are in b; 0 if a has none."""
    return T.let(F.array_distinct(a), lambda x: T.ratio(F.size(F.array_intersect(x, b)), F.size(x)))


def grams(pairs: DataFrame) -> DataFrame:
    ta, tb, xa, xb = T.tokens_content("a"), T.tokens_content("b"), T.tokens_all("a"), T.tokens_all("b")
    return pairs.select("check_id", containment(T.word_grams(ta, 2), T.word_grams(tb, 2)).alias("bigram"), containment(T.word_grams(ta, 3), T.word_grams(tb, 3)).alias("trigram"), containment(T.word_grams(xa, 4), T.word_grams(xb, 4)).alias("fourgram"))


def pair_scores(single_checks: DataFrame) -> DataFrame:
    """check_id, cosine, bm25, bigram, trigram, fourgram, combined, pct of every check."""
    pairs = checks(single_checks)
    s = P.scores(P.postings(pairs, ["check_id"], T.tokens_content("a")), P.postings(pairs, ["check_id"], T.tokens_content("b")), ["check_id"], [], [])
    rows = grams(pairs).join(s, "check_id", "left").na.fill(0.0, ["cosine", "bm25"])
    combined = F.least(sum(F.col(k) * w for k, w in WEIGHTS.items()), F.lit(1.0))
    return rows.select("check_id", *[T.rounded(F.col(k), 4).alias(k) for k in WEIGHTS], T.rounded(combined, 4).alias("combined"), T.percent(T.rounded(combined, 9)).alias("pct"))


def matching_phrases(single_checks: DataFrame, limit: int = 25) -> DataFrame:
    """check_id, n, phrases: the first distinct 3-grams, then 5-grams of all tokens of the submission that are in the
    reference, joined by ' | '."""
    xa, xb = T.tokens_all("a"), T.tokens_all("b")
    both = F.array_union(F.array_intersect(T.word_grams(xa, 3), T.word_grams(xb, 3)), F.array_intersect(T.word_grams(xa, 5), T.word_grams(xb, 5)))
    rows = checks(single_checks).select("check_id", F.slice(both, 1, limit).alias("p"))
    return rows.select("check_id", F.size("p").cast("long").alias("n"), F.array_join("p", " | ").alias("phrases"))


def sentence_matches(single_checks: DataFrame, threshold: float = 0.45, least: int = 3) -> DataFrame:
    """check_id, index_a, index_b, similarity: the most similar reference sentence of each submission sentence, if it reaches
    the threshold; the first of equals. Boilerplate and sentences of fewer than `least` content tokens are left out."""
    pairs = checks(single_checks)

    def side(c: str, key: str) -> DataFrame:
        units = pairs.select("check_id", F.posexplode(T.sentences_lexical(c)).alias(key, "s"))
        units = units.withColumn("t", T.tokens_content("s")).filter((F.size("t") >= least) & ~T.is_boilerplate(F.col("s")))
        return P.postings(units, ["check_id", key], F.col("t"))

    s = P.scores(side("a", "index_a"), side("b", "index_b"), ["check_id"], ["index_a"], ["index_b"]).withColumn("sim", T.rounded(F.col("cosine"), 9))
    best = s.groupBy("check_id", "index_a").agg(F.min(F.struct((-F.col("sim")).alias("s"), "index_b")).alias("m"))
    return best.filter(F.col("m.s") <= -threshold).select("check_id", F.col("index_a").cast("long").alias("index_a"), F.col("m.index_b").cast("long").alias("index_b"), T.rounded(-F.col("m.s"), 4).alias("similarity"))


def _windows(single_checks: DataFrame) -> DataFrame:
    """check_id, ia, ib, score: best reference chunk (half cosine, half BM25) of each submission chunk."""
    pairs = checks(single_checks)

    def side(c: str, key: str) -> DataFrame:
        units = pairs.select("check_id", F.posexplode(T.lexical_chunks(c)).alias(key, "s")).withColumn("t", T.tokens_content("s")).filter(F.size("t") >= 3)
        return P.postings(units, ["check_id", key], F.col("t"))

    s = P.scores(side("a", "ia"), side("b", "ib"), ["check_id"], ["ia"], ["ib"]).withColumn("score", T.rounded(0.5 * F.col("bm25") + 0.5 * F.col("cosine"), 9))
    return s.groupBy("check_id", "ia").agg(F.min(F.struct((-F.col("score")).alias("s"), "ib")).alias("m")).select("check_id", "ia", F.col("m.ib").alias("ib"), (-F.col("m.s")).alias("score"))


def window_matches(single_checks: DataFrame, threshold: float = 0.35, limit: int = 15) -> DataFrame:
    """check_id, rank, index_a, index_b, score, pct, preview: the best `limit` windows over the threshold, by rounded score
    (ties: order in the text), with the first 160 characters of the submission's window."""
    texts = checks(single_checks).select("check_id", F.posexplode(T.lexical_chunks("a")).alias("ia", "chunk"))
    kept = _windows(single_checks).filter(F.col("score") > threshold).withColumn("r4", T.rounded(F.col("score"), 4))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("check_id").orderBy(F.desc("r4"), "ia"))).filter(F.col("rank") <= limit)
    preview = F.when(F.length("chunk") > 160, F.concat(F.substring("chunk", 1, 160), F.lit("..."))).otherwise(F.col("chunk"))
    return ranked.join(texts, ["check_id", "ia"]).select("check_id", F.col("rank").cast("long").alias("rank"), F.col("ia").cast("long").alias("index_a"), F.col("ib").cast("long").alias("index_b"), F.col("r4").alias("score"), T.percent(F.col("score")).alias("pct"), preview.alias("preview"))


def window_overall(single_checks: DataFrame, threshold: float = 0.35) -> DataFrame:
    """check_id, chunks, matched, overall, mosaic_gaps, mosaic: sum of the matched windows' scores over all chunks, and
    whether three or more matched windows (over 0.45) are followed by another one with a gap."""
    n = checks(single_checks).select("check_id", F.size(T.lexical_chunks("a")).cast("long").alias("chunks"))
    kept = _windows(single_checks).filter(F.col("score") > threshold)
    by = Window.partitionBy("check_id").orderBy("ia")
    gap = (F.lead("ia").over(by) - F.col("ia") > 1) & (T.rounded(F.col("score"), 4) > 0.45) & (T.rounded(F.lead("score").over(by), 4) > 0.45)
    sums = kept.withColumn("gap", F.coalesce(gap, F.lit(False))).groupBy("check_id").agg(F.count("*").alias("matched"), F.sum("score").alias("total"), F.count_if("gap").alias("mosaic_gaps"))
    return n.join(sums, "check_id", "left").na.fill(0).select("check_id", "chunks", "matched", T.rounded(F.least(F.col("total") / F.col("chunks"), F.lit(1.0)), 4).alias("overall"), "mosaic_gaps", (F.col("mosaic_gaps") >= 3).alias("mosaic"))


def cross_document_links(documents: DataFrame, every: int = 20, least_pct: int = 20) -> DataFrame:
    """doc_id, links, best_id, best_pct of every document whose id is divisible by `every`: how many others have a similarity
    over least_pct with it, and the nearest (ties: smallest id); 0 links: null, 0. Rows of one doc_id are one document, whose
    grams count once for each row.

    All pairs over the limit share a content token (without one, only 4-grams of all tokens can match, for at most 10
    percent). They are found by blocks of postings (see blocks), and no pair is stored.
    """
    documents = documents.filter("doc_id is not null")
    count = B.parts(documents, documents.count(), B.PLANNED // 2)
    sorted_ = documents.select("doc_id", "text").repartition(count, "doc_id").sortWithinPartitions("doc_id")
    tokens = sorted_.select("doc_id", T.tokens_all("text").alias("t"))
    blocks = stored(tokens.mapInArrow(lambda stream: B.token_blocks(stream, every), "d array<binary>, q array<binary>"))
    queries = max(1, -(-2 * cores(documents.sparkSession) // count), -(-count // 64))
    found = B.met(blocks, B.open_tokens, lambda block, raw: B.nearest_links(block, raw, least_pct), "q long, links long, pct long, o long", queries)
    best = found.groupBy("q").agg(F.sum("links").alias("links"), F.min(F.struct((-F.col("pct")).alias("p"), "o")).alias("m"))
    asked = documents.filter(F.col("doc_id") % every == 0).select("doc_id").distinct()
    return asked.join(best, asked["doc_id"] == best["q"], "left").select("doc_id", F.coalesce("links", F.lit(0)).alias("links"), F.col("m.o").alias("best_id"), F.coalesce(-F.col("m.p"), F.lit(0)).alias("best_pct"))
