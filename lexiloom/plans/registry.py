"""The registered queries: every operator on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import alignment, pairs, paraphrase, postings, reports, sketch, style
from lexiloom.session import spread, table
from lexiloom.sources import files, lookup, sinks


def _joined(tokens):
    def run(d: DataFrame) -> DataFrame:
        t = tokens("text")
        return d.select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))

    return run


def _units(split):
    return lambda d: d.select("doc_id", F.posexplode(split("text")).alias("idx", "unit")).select("doc_id", F.col("idx").cast("long").alias("idx"), "unit")


def _boilerplate(d: DataFrame) -> DataFrame:
    return d.select("doc_id", F.posexplode(T.sentences_lexical("text")).alias("idx", "s")).filter(T.is_boilerplate(F.col("s"))).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("s").alias("unit"))


def _ngrams(d: DataFrame) -> DataFrame:
    t = T.tokens_all("text")
    n = lambda k: F.size(F.array_distinct(T.word_grams(t, k))).cast("long")
    return d.select("doc_id", n(2).alias("bigrams"), n(3).alias("trigrams"), n(4).alias("fourgrams"), n(5).alias("fivegrams"))


def _char_grams(d: DataFrame) -> DataFrame:
    k, s = T.char_grams(T.fingerprint_text("text"), 5), T.char_grams(T.spaced_text("text"), 4)
    return d.select("doc_id", F.size(k).cast("long").alias("kgrams"), F.size(F.array_distinct(k)).cast("long").alias("distinct_kgrams"), F.size(F.array_distinct(s)).cast("long").alias("distinct_spaced"))


def _synonyms(d: DataFrame) -> DataFrame:
    return paraphrase.synonyms_of(postings.document_frequency(d).select(F.col("term").alias("word")))


def _inverted_round_trip(d: DataFrame) -> DataFrame:
    """doc_id, same: whether the inverted index of a document gives its tokens back."""
    d = d.groupBy("doc_id").agg(F.min(T.text_of("text")).alias("text"))
    index = d.select("doc_id", F.posexplode(T.tokens_all("text")).alias("p", "w")).groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    back = lookup.from_inverted(index, "doc_id", "index")
    return d.join(back.withColumnRenamed("text", "back"), "doc_id", "left").select("doc_id", (F.array_join(T.tokens_all(F.col("text")), " ") == F.coalesce("back", F.lit(""))).alias("same"))


def _csv_lines(d: DataFrame, p: DataFrame, c: DataFrame) -> DataFrame:
    return reports.bulk_report(d, p, c).select("doc_id", sinks.csv_row(F.col("document"), F.col("word_count"), F.col("plagiarism"), F.col("ai_content")).alias("line"))


def _html(s: DataFrame) -> DataFrame:
    return sinks.html_report(s.select("source_id", "url", "snippet").distinct(), "source_id", F.col("url"), F.col("snippet"))


def _derived(c: DataFrame) -> DataFrame:
    rows = pairs.pair_scores(c).select("check_id", "cosine", "pct").join(alignment.similarity(c).select("check_id", F.col("similarity").alias("lcs")), "check_id")
    return reports.derived_percentages(rows)


def _one_against_many(d: DataFrame) -> DataFrame:
    """doc_id, similarity of the document of the smallest id with every document."""
    target = d.filter("doc_id is not null").agg(F.min(F.struct("doc_id", T.text_of("text").alias("text"))).alias("t")).select(F.col("t.text").alias("text"))
    return alignment.one_against_many(target, d, "doc_id", "text")


#: Tables of texts: read in fewer partitions than there are cores, they are spread over them first.
TEXTS = ("documents", "single_checks", "sentence_matches")

#: Query -> (function of tables, their names).
PLANS: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "text_stats": (reports.text_stats, ("documents",)),
    "tokens_content": (_joined(T.tokens_content), ("documents",)),
    "tokens_all": (_joined(T.tokens_all), ("documents",)),
    "tokens_style": (_joined(T.tokens_style), ("documents",)),
    "tokens_canonical": (paraphrase.canonical_tokens, ("documents",)),
    "synonyms_of": (_synonyms, ("documents",)),
    "sentences_lexical": (_units(T.sentences_lexical), ("documents",)),
    "sentences_style": (_units(T.sentences_style), ("documents",)),
    "boilerplate_sentences": (_boilerplate, ("documents",)),
    "lexical_chunks": (_units(T.lexical_chunks), ("documents",)),
    "ngram_counts": (_ngrams, ("documents",)),
    "char_grams": (_char_grams, ("documents",)),
    "term_frequency": (lambda d: postings.term_frequency(d).select("doc_id", "term", F.col("cnt").cast("long").alias("cnt"), T.rounded(F.col("tf"), 6).alias("tf")), ("documents",)),
    "document_frequency": (postings.document_frequency, ("documents",)),
    "tfidf_top_terms": (postings.tfidf_top, ("documents",)),
    "corpus_cosine": (postings.corpus_cosine, ("documents",)),
    "pair_similarity": (pairs.pair_scores, ("single_checks",)),
    "matching_phrases": (pairs.matching_phrases, ("single_checks",)),
    "sentence_matches": (pairs.sentence_matches, ("single_checks",)),
    "window_matches": (pairs.window_matches, ("single_checks",)),
    "window_overall": (pairs.window_overall, ("single_checks",)),
    "cross_document_links": (pairs.cross_document_links, ("documents",)),
    "style_signals": (style.style_signals, ("documents",)),
    "punctuation": (style.punctuation, ("documents",)),
    "marker_phrases": (style.marker_phrases, ("documents",)),
    "phrase_signatures": (style.signatures, ("documents",)),
    "curvature": (style.curvature, ("documents",)),
    "style_variance": (style.style_variance, ("documents",)),
    "machine_style": (style.machine_style, ("documents",)),
    "rabin_hashes": (sketch.rabin, ("documents",)),
    "winnowed": (sketch.winnowed, ("documents",)),
    "fingerprint_compare": (sketch.fingerprint_compare, ("single_checks",)),
    "copied_blocks": (sketch.copied_blocks, ("single_checks",)),
    "simhash": (sketch.simhashes, ("documents",)),
    "simhash_compare": (sketch.simhash_compare, ("single_checks",)),
    "near_paragraphs": (sketch.near_paragraphs, ("single_checks",)),
    "minhash_values": (sketch.minhash_values, ("documents",)),
    "minhash_compare": (sketch.minhash_compare, ("single_checks",)),
    "minhash_matrix": (sketch.minhash_matrix, ("documents",)),
    "char_similarity": (paraphrase.char_similarity, ("single_checks",)),
    "synonym_overlap": (paraphrase.synonym_overlap, ("single_checks",)),
    "synonym_substitutions": (paraphrase.substitutions, ("single_checks",)),
    "word_order": (paraphrase.word_order, ("single_checks",)),
    "paraphrase": (paraphrase.paraphrase, ("single_checks",)),
    "sentence_overlap": (paraphrase.sentence_overlap, ("sentence_matches",)),
    "lcs_similarity": (alignment.similarity, ("single_checks",)),
    "lcs_words": (alignment.words, ("single_checks",)),
    "local_alignment": (alignment.local, ("single_checks",)),
    "alignment_report": (alignment.report, ("single_checks",)),
    "one_against_many": (_one_against_many, ("documents",)),
    "derived_percentages": (_derived, ("single_checks",)),
    "files_validated": (files.validated, ("parsed_files",)),
    "files_dispatched": (files.dispatched, ("parsed_files",)),
    "session_inputs": (files.session_inputs, ("parsed_files",)),
    "corpus_names": (files.corpus, ("parsed_files",)),
    "file_sizes": (files.file_sizes, ("parsed_files",)),
    "source_snippets": (lookup.snippets, ("source_rows",)),
    "source_queries": (lookup.queries, ("documents",)),
    "found_sources": (lookup.found_sources, ("documents", "source_rows")),
    "source_attribution": (lookup.attribution, ("single_checks",)),
    "inverted_index": (lookup.inverted, ("documents",)),
    "inverted_round_trip": (_inverted_round_trip, ("documents",)),
    "csv_lines": (_csv_lines, ("documents", "similar_pairs", "single_checks")),
    "single_report": (reports.single_report, ("single_checks",)),
    "report_sources": (reports.report_sources, ("single_checks",)),
    "html_reports": (_html, ("source_rows",)),
    "highlights": (sinks.highlights, ("documents", "sentence_matches")),
    "flagged_sentences": (sinks.flagged, ("documents", "sentence_matches")),
    "max_related": (reports.max_related, ("documents", "similar_pairs")),
    "pair_report": (reports.pair_report, ("similar_pairs",)),
    "document_summary": (reports.document_summary, ("documents", "similar_pairs", "single_checks")),
    "bulk_counters": (reports.bulk_counters, ("documents", "similar_pairs", "single_checks")),
}


def _bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    plan, names = PLANS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(*(spread(table(spark, sf_dir, n)) if n in TEXTS else table(spark, sf_dir, n) for n in names))

    query.__name__, query.__doc__ = name, plan.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bound(name) for name in PLANS}
