"""Looking up sources of a text in a local table, and taking text out of markup, indexes, XML and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import postings as P

#: Sentences sampled from a text, tokens of a query, and results kept for each.
SAMPLES, QUERY_TOKENS, TOP = 8, 7, 5


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>?", "")


def snippets(source_rows: DataFrame) -> DataFrame:
    """source_id, type, text: the snippets without markup; types trimmed and in lower case, null as 'unknown'; one row for each
    url (the first by id)."""
    first = source_rows.groupBy("url").agg(F.min(F.struct("source_id", "type", "snippet")).alias("r")).select("r.*")
    return first.select("source_id", F.coalesce(F.lower(F.trim("type")), F.lit("unknown")).alias("type"), T.trimmed(strip_markup(T.text_of("snippet"))).alias("text"))


def queries(documents: DataFrame) -> DataFrame:
    """doc_id, sample, query: every (n / 8)-th lexical sentence, at most 8; its first 7 tokens."""
    s = T.sentences_lexical("text")
    rows = documents.select("doc_id", s.alias("s"))
    step = F.greatest(F.lit(1), F.floor(F.size("s") / SAMPLES).cast("int"))
    chosen = F.slice(F.filter("s", lambda x, i: i % step == 0), 1, SAMPLES)
    return rows.select("doc_id", F.posexplode(chosen).alias("sample", "sentence")).select("doc_id", F.col("sample").cast("long").alias("sample"), F.array_join(F.slice(T.tokens_all("sentence"), 1, QUERY_TOKENS), " ").alias("query"))


def found_sources(documents: DataFrame, source_rows: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, rank, source_id, shared: the sources that share most distinct query tokens (of more than two letters) with a
    document's queries; ties by id. The table of sources is joined by token."""
    q = queries(documents).select("doc_id", F.explode(F.filter(F.split("query", " "), lambda t: F.length(t) > 2)).alias("t")).distinct()
    src = snippets(source_rows).select("source_id", F.explode(F.array_distinct(T.tokens_all("text"))).alias("t"))
    hits = q.join(src, "t").groupBy("doc_id", "source_id").agg(F.count("*").alias("shared"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("shared"), "source_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("doc_id", F.col("rank").cast("long").alias("rank"), "source_id", "shared")


def attribution(single_checks: DataFrame) -> DataFrame:
    """check_id, url, pct: how similar the submission is to each of its own sources (cosine of both alone, in percent; above 0
    only). A measure, where the published behaviour draws numbers at random."""
    one = single_checks.groupBy("check_id").agg(F.min(F.struct(T.text_of("submission").alias("a"), F.col("sources"))).alias("s")).select("check_id", "s.a", "s.sources")
    units = one.select("check_id", F.explode("sources").alias("x")).filter("x.url is not null").groupBy("check_id", F.col("x.url").alias("url")).agg(F.min(strip_markup(T.text_of("x.snippet"))).alias("t"))
    s = P.scores(P.postings(one, ["check_id"], T.tokens_content("a")), P.postings(units, ["check_id", "url"], T.tokens_content("t")), ["check_id"], [], ["url"])
    return s.select("check_id", "url", T.percent(T.rounded(F.col("cosine"), 9)).alias("pct")).filter("pct > 0")


def from_inverted(rows: DataFrame, key: str, index: str) -> DataFrame:
    """key, text of an index word -> positions (a map column): the words in order of their positions, joined by blanks. A null
    or empty map gives an empty text."""
    words = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return rows.select(key, F.coalesce(F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "), F.lit("")).alias("text"))


def inverted(documents: DataFrame) -> DataFrame:
    """doc_id, term, positions (joined by commas): the inverted index of all tokens, which from_inverted turns back."""
    each = documents.select("doc_id", F.posexplode(T.tokens_all("text")).alias("pos", "term"))
    return each.groupBy("doc_id", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("positions"))


def xml_entries(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key, entry, id, title, summary of each <entry> of a feed; missing parts are empty, inner white space one blank."""
    part = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " ")).alias(tag)
    return rows.select(key, F.posexplode(F.regexp_extract_all(T.text_of(xml), F.lit(r"(?s)<entry[^>]*>(.*?)</entry>"), F.lit(1))).alias("entry", "e")).select(key, "entry", part("id"), part("title"), part("summary"))


def json_sources(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, title, url, snippet of the results of a JSON answer; malformed answers and missing fields give no row or null."""
    kind = "struct<results:array<struct<title:string,url:string,snippet:string>>>"
    return rows.select(key, F.explode(F.from_json(body, kind)["results"]).alias("r")).select(key, "r.title", "r.url", F.regexp_replace(F.coalesce("r.snippet", F.lit("")), r"<[^>]*>?", "").alias("snippet"))


def search_url(base: str, query: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(query))
