"""Statistics and summaries by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import alignment, pairs, sketch, style
from lexiloom.sources import lookup

#: A reference text is compared if it has more characters than this; in the summary of many documents, than that.
LEAST_REFERENCE, LEAST_REFERENCE_BULK = 50, 30


def counted(text: str = "text") -> tuple[Column, Column]:
    """Words and lexical sentences of a text."""
    words = F.filter(F.split(T.trimmed(T.text_of(text)), f"{T.SPACE}+"), lambda w: F.length(w) > 0)
    return F.size(words).cast("long"), F.size(T.sentences_lexical(text)).cast("long")


def text_stats(documents: DataFrame) -> DataFrame:
    """doc_id, words, sentences, chars (without white space), unique_words, diversity, avg_sentence, minutes of every
    document; a null text counts as empty (0 words, 1 minute)."""
    t = T.text_of("text")
    words = F.filter(F.split(T.trimmed(t), f"{T.SPACE}+"), lambda w: F.length(w) > 0)
    rows = documents.select("doc_id", t.alias("t"), words.alias("w"), F.size(T.sentences_lexical("text")).alias("s"))
    n, u = F.size("w"), F.size(F.array_distinct(F.transform("w", lambda x: F.lower(x))))
    return rows.select(
        "doc_id", n.cast("long").alias("words"), F.col("s").cast("long").alias("sentences"), F.length(F.regexp_replace("t", T.SPACE, "")).cast("long").alias("chars"), u.cast("long").alias("unique_words"),
        T.rounded(u / F.greatest(n, F.lit(1)), 3).alias("diversity"), T.rounded(n / F.greatest("s", F.lit(1)), 1).alias("avg_sentence"), F.greatest(F.lit(1), F.ceil(n / 200)).cast("long").alias("minutes"))


def max_related(documents: DataFrame, similar_pairs: DataFrame) -> DataFrame:
    """name, max_pct: the largest pct of any pair row that names a document on either side; 0 without one."""
    sides = similar_pairs.filter("pct is not null").select(F.explode(F.array_distinct(F.array("doc_a", "doc_b"))).alias("name"), "pct").filter("name is not null").groupBy("name").agg(F.max("pct").alias("max_pct"))
    return documents.filter("name is not null").select("name").distinct().join(sides, "name", "left").select("name", F.coalesce("max_pct", F.lit(0)).cast("long").alias("max_pct"))


def risk_band(pct: Column) -> Column:
    return F.when(pct >= 60, "high").when(pct >= 30, "moderate").otherwise("low")


def document_summary(documents: DataFrame, similar_pairs: DataFrame, single_checks: DataFrame | None = None) -> DataFrame:
    """doc_id, name, words, sentences, style_pct, verdict, similar_pct, max_pct, band of every document (one row for each doc_id).

    similar_pct is the largest similarity of the document's checks with a reference of more than 30 characters, 0 without one
    or without checks.
    One pass over the texts; what is exchanged and joined are numbers and names.
    """
    words, sentences = counted()
    base = documents.select("doc_id", "name", "text", words.alias("n_words"), sentences.alias("n_sentences"))
    look = style.scored(base, ("doc_id", "name", "n_words", "n_sentences"))
    look = style.once(look.select("doc_id", "name", F.col("n_words").alias("words"), F.col("n_sentences").alias("sentences"), F.col("pct").alias("style_pct"), "verdict"))
    if single_checks is None:
        single_checks = documents.sparkSession.createDataFrame([], "check_id long, doc_id long, submission string, reference string")
    of_check = single_checks.filter("doc_id is not null").groupBy("check_id").agg(F.min("doc_id").alias("doc_id"))
    enough = single_checks.filter(F.length("reference") > LEAST_REFERENCE_BULK)
    checked = pairs.pair_scores(enough).select("check_id", "pct").join(of_check, "check_id").groupBy("doc_id").agg(F.max("pct").alias("similar_pct"))
    rows = look.join(checked, "doc_id", "left").join(max_related(documents, similar_pairs), "name", "left")
    pct = F.coalesce("max_pct", F.lit(0))
    return rows.select("doc_id", "name", "words", "sentences", "style_pct", "verdict", F.coalesce("similar_pct", F.lit(0)).alias("similar_pct"), pct.alias("max_pct"), risk_band(pct).alias("band"))


def bulk_counters(documents: DataFrame, similar_pairs: DataFrame, single_checks: DataFrame | None = None) -> DataFrame:
    """docs, similar_docs (max_pct >= 40), styled_docs (style_pct >= 60), strong_pairs (pair rows with pct >= 60): one row."""
    zero = F.lit(0).cast("long")
    rows = document_summary(documents, similar_pairs, single_checks)
    of_docs = rows.agg(F.count("*").alias("docs"), F.count_if(F.col("max_pct") >= 40).alias("similar_docs"), F.count_if(F.col("style_pct") >= 60).alias("styled_docs")).withColumn("strong_pairs", zero)
    strong = similar_pairs.select("pair_id", "pct").distinct().filter("pct >= 60").agg(F.count("*").alias("strong_pairs"))
    both = of_docs.union(strong.select(zero, zero, zero, "strong_pairs"))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def bulk_report(documents: DataFrame, similar_pairs: DataFrame, single_checks: DataFrame | None = None) -> DataFrame:
    """doc_id, document, word_count, plagiarism, ai_content: the rows of the report on many documents, percentages as text."""
    rows = document_summary(documents, similar_pairs, single_checks)
    percent = lambda c: F.concat(F.col(c).cast("string"), F.lit("%"))
    return rows.select("doc_id", F.col("name").alias("document"), F.col("words").alias("word_count"), percent("similar_pct").alias("plagiarism"), percent("style_pct").alias("ai_content"))


def single_report(single_checks: DataFrame) -> DataFrame:
    """check_id, section, metric, value, percentage: the report on each check. Document: figures of the submission, among them the
    characters estimated from its words; Similarity: the six scores, 0 where the reference has 50 characters or fewer; Style:
    percentage, verdict and certainty. The column percentage is empty but for scores."""
    one = pairs.checks(single_checks)
    stats = text_stats(one.select(F.col("check_id").alias("doc_id"), F.col("a").alias("text"))).withColumnRenamed("doc_id", "check_id")
    look = style.scored(one.select("check_id", F.col("a").alias("text")), ("check_id",)).select("check_id", F.col("pct").alias("style_pct"), "verdict", "certainty")
    scores = pairs.pair_scores(single_checks).select("check_id", "cosine", "bigram", "trigram", "combined")
    prints = sketch.fingerprint_compare(single_checks).select("check_id", F.col("jaccard").alias("fingerprint"))
    lcs = alignment.similarity(single_checks).select("check_id", F.col("similarity").alias("lcs"))
    long = one.select("check_id", (F.length("b") > LEAST_REFERENCE).alias("enough"))
    rows = long.join(stats, "check_id").join(look, "check_id").join(scores, "check_id").join(prints, "check_id").join(lcs, "check_id")
    text = lambda name, c: F.struct(F.lit("Document").alias("section"), F.lit(name).alias("metric"), c.cast("string").alias("value"), F.lit("").alias("percentage"))
    parts = [text(c, F.col(c)) for c in ("words", "sentences", "unique_words", "diversity", "minutes")] + [text("estimated_chars", estimated_chars(F.col("words")))]
    for c in ("cosine", "bigram", "trigram", "fingerprint", "lcs", "combined"):
        v = F.when(F.col("enough"), F.col(c)).otherwise(0.0)
        parts.append(F.struct(F.lit("Similarity").alias("section"), F.lit(c).alias("metric"), v.cast("string").alias("value"), F.concat(T.percent(v).cast("string"), F.lit("%")).alias("percentage")))
    for name, c in (("percent", "style_pct"), ("verdict", "verdict"), ("certainty", "certainty")):
        parts.append(F.struct(F.lit("Style").alias("section"), F.lit(name).alias("metric"), F.col(c).cast("string").alias("value"), F.lit("").alias("percentage")))
    return rows.select("check_id", F.explode(F.array(*parts)).alias("x")).select("check_id", "x.*")


def estimated_chars(words: Column) -> Column:
    """Characters as the report estimates them: 5.2 a word. text_stats has the true ones."""
    return F.floor(words * 5.2 + 0.5).cast("long")


def report_sources(single_checks: DataFrame) -> DataFrame:
    """check_id, rank, url, type, pct, measured: the sources of a report by falling similarity (ties by url). A check without a
    source has its reference text as the only one (url null, type 'reference'), if there is one."""
    own = lookup.attribution(single_checks)
    kinds = single_checks.select("check_id", F.explode("sources").alias("s")).filter("s.url is not null").groupBy("check_id", F.col("s.url").alias("url")).agg(F.min(F.coalesce(F.lower(F.trim("s.type")), F.lit("unknown"))).alias("type"))
    listed = kinds.join(own, ["check_id", "url"], "left").select("check_id", "url", "type", F.coalesce("pct", F.lit(0)).cast("long").alias("pct"), F.lit(True).alias("measured"))
    bare = single_checks.filter(F.length("reference") > LEAST_REFERENCE).select("check_id").distinct().join(kinds.select("check_id").distinct(), "check_id", "left_anti")
    derived = pairs.pair_scores(single_checks).join(bare, "check_id", "left_semi").select("check_id", F.lit(None).cast("string").alias("url"), F.lit("reference").alias("type"), "pct", F.lit(False).alias("measured"))
    by = Window.partitionBy("check_id").orderBy(F.desc("pct"), "url")
    return listed.union(derived).withColumn("rank", F.row_number().over(by)).select("check_id", F.col("rank").cast("long").alias("rank"), "url", "type", "pct", "measured")


def pair_report(similar_pairs: DataFrame, limit: int = 20) -> DataFrame:
    """doc_a, doc_b, pct: the top pairs by pct (each unordered pair once, by its largest pct), ties by name."""
    a, b = F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b")
    rows = similar_pairs.filter("doc_a is not null and doc_b is not null and pct is not null and doc_a <> doc_b").groupBy(a.alias("doc_a"), b.alias("doc_b")).agg(F.max("pct").alias("pct"))
    return rows.orderBy(F.desc("pct"), "doc_a", "doc_b").limit(limit).select("doc_a", "doc_b", F.col("pct").cast("long").alias("pct"))


def derived_percentages(single: DataFrame) -> DataFrame:
    """check_id, raised, of_cosine, of_lcs: fixed multiples of other scores, named as what they are; no measurements."""
    cap = lambda c: F.least(F.lit(100), F.floor(c + F.lit(0.5)).cast("int")).cast("long")
    return single.select("check_id", cap(F.col("pct") * 1.02).alias("raised"), cap(F.col("cosine") * 66).alias("of_cosine"), cap(F.col("lcs") * 84).alias("of_lcs"))
