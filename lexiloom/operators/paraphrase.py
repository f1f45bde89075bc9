"""Synonym-aware paraphrase signals of a submission and a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import lexicon
from lexiloom.functions import text as T
from lexiloom.operators.pairs import checks


#: Rows up to which the table of synonym pairs is broadcast.
SMALL_TABLE = 100_000


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct elements; 0 if both are empty."""
    return T.let(F.array_distinct(a), lambda x: T.let(F.array_distinct(b), lambda y: T.ratio(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))))


def char_jaccard(n: int) -> Column:
    return jaccard(T.char_grams(T.spaced_text("a"), n), T.char_grams(T.spaced_text("b"), n))


def char_similarity(single_checks: DataFrame) -> DataFrame:
    """check_id, char3, char4, char5 and their mean."""
    rows = checks(single_checks).select("check_id", *[char_jaccard(n).alias(f"char{n}") for n in (3, 4, 5)])
    mean = (F.col("char3") + F.col("char4") + F.col("char5")) / 3
    return rows.select("check_id", *[T.rounded(F.col(f"char{n}"), 4).alias(f"char{n}") for n in (3, 4, 5)], T.rounded(mean, 4).alias("mean"))


def synonym_overlap(single_checks: DataFrame, groups=lexicon.SYNONYMS) -> DataFrame:
    """check_id, overlap: Jaccard of the canonical words."""
    return checks(single_checks).select("check_id", T.rounded(jaccard(T.tokens_canonical("a", groups), T.tokens_canonical("b", groups)), 4).alias("overlap"))


def canonical_tokens(documents: DataFrame, groups=lexicon.SYNONYMS) -> DataFrame:
    """doc_id, n, changed, tokens: the canonical words of each document, joined by blanks."""
    t = T.tokens_letters("text")
    c = T.tokens_canonical("text", groups)
    return documents.select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.filter(F.zip_with(t, c, lambda x, y: x != y), lambda e: e)).cast("long").alias("changed"), F.array_join(c, " ").alias("tokens"))


def synonyms_of(words: DataFrame, groups=lexicon.SYNONYMS) -> DataFrame:
    """word, canonical, synonyms (joined by ' | ', empty if there are none) of the words in column word."""
    table = lexicon.synonym_groups(groups)
    lists = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, " | ".join(v))])
    c = T.canonical(F.lower("word"), groups)
    return words.select("word", c.alias("canonical"), F.coalesce(F.element_at(lists, c), F.lit("")).alias("synonyms"))


def substitutions(single_checks: DataFrame, groups=lexicon.SYNONYMS, limit: int = 20) -> DataFrame:
    """check_id, rank, original, synonym, canonical: the first `limit` distinct pairs of a word of the submission and another
    synonym of its group, all of whose words the reference has."""
    names = [(w, c, i, s) for w, c in lexicon.canonical_words(groups).items() if " " not in w for i, s in enumerate(lexicon.synonym_groups(groups)[c])]
    spark = single_checks.sparkSession
    table = spark.createDataFrame(sorted(names), "original string, canonical string, place int, synonym string")
    pairs = checks(single_checks).select("check_id", T.tokens_letters("a").alias("ta"), F.array_distinct(T.tokens_letters("b")).alias("tb"))
    each = pairs.select("check_id", "tb", F.posexplode("ta").alias("pos", "original")).groupBy("check_id", "original").agg(F.min("pos").alias("pos"), F.first("tb").alias("tb"))
    # a parameter table, sent to every task as long as it is small
    hits = each.join(F.broadcast(table) if len(names) <= SMALL_TABLE else table, "original")
    hits = hits.filter((F.col("original") != F.col("synonym")) & F.forall(F.split("synonym", " "), lambda w: F.array_contains(F.col("tb"), w)))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("check_id").orderBy("pos", "place")))
    return ranked.filter(F.col("rank") <= limit).select("check_id", F.col("rank").cast("long").alias("rank"), "original", "synonym", "canonical")


def _orders(single_checks: DataFrame, groups) -> DataFrame:
    """check_id, rho: Spearman correlation of the first places of the common canonical words, within 0 and 1; checks with
    fewer than four common words are missing."""
    pairs = checks(single_checks)

    def side(c: str, out: str) -> DataFrame:
        return pairs.select("check_id", F.posexplode(T.tokens_canonical(c, groups)).alias("pos", "w")).groupBy("check_id", "w").agg(F.min("pos").alias(out))

    both = side("a", "pa").join(side("b", "pb"), ["check_id", "w"])
    d = F.row_number().over(Window.partitionBy("check_id").orderBy("pa")) - F.row_number().over(Window.partitionBy("check_id").orderBy("pb"))
    sums = both.withColumn("d", d).groupBy("check_id").agg(F.sum(F.col("d") * F.col("d")).alias("dd"), F.count("*").alias("n")).filter("n >= 4")
    rho = 1 - 6 * F.col("dd") / (F.col("n") * (F.col("n") * F.col("n") - 1))
    return sums.select("check_id", F.greatest(F.lit(0.0), F.least(rho, F.lit(1.0))).alias("rho"))


def word_order(single_checks: DataFrame, groups=lexicon.SYNONYMS) -> DataFrame:
    """check_id, rho of every check; 0 with fewer than four common words."""
    return checks(single_checks).select("check_id").join(_orders(single_checks, groups), "check_id", "left").select("check_id", T.rounded(F.coalesce("rho", F.lit(0.0)), 4).alias("rho"))


def paraphrase(single_checks: DataFrame, groups=lexicon.SYNONYMS) -> DataFrame:
    """check_id, score, pct, verdict: .35 mean character similarity + .40 synonym overlap + .25 word order."""
    rows = checks(single_checks).select("check_id", ((char_jaccard(3) + char_jaccard(4) + char_jaccard(5)) / 3).alias("c"), jaccard(T.tokens_canonical("a", groups), T.tokens_canonical("b", groups)).alias("s"))
    rows = rows.join(_orders(single_checks, groups), "check_id", "left").na.fill(0.0, ["rho"])
    score = T.rounded(F.least(F.col("c") * 0.35 + F.col("s") * 0.40 + F.col("rho") * 0.25, F.lit(1.0)), 9)
    return rows.select("check_id", score.alias("x")).select("check_id", T.rounded(F.col("x"), 4).alias("score"), T.percent(F.col("x")).alias("pct"), F.when(F.col("x") >= 0.55, "High Paraphrase Risk").when(F.col("x") >= 0.35, "Moderate Paraphrase Risk").otherwise("Low Paraphrase Risk").alias("verdict"))


def sentence_overlap(sentence_matches: DataFrame, groups=lexicon.SYNONYMS) -> DataFrame:
    """match_id, overlap: Jaccard of the canonical words of both sentences of a match; 0 if either has none or is null. A
    match_id that comes twice has one row (the largest overlap)."""
    a, b = T.tokens_canonical("sentence_a", groups), T.tokens_canonical("sentence_b", groups)
    rows = sentence_matches.select("match_id", F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(jaccard(a, b)).alias("o"))
    return rows.groupBy("match_id").agg(T.rounded(F.max("o"), 4).alias("overlap"))
