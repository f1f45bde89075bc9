"""Reports as files: JSON, CSV with every cell quoted, and HTML text in place of drawn pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_csv(report: DataFrame, path: str) -> None:
    """All cells quoted, quotes doubled, rows ended by CR LF as far as the writer supports it (two-character line ends are made
    in the cells' last column otherwise: here LF)."""
    report.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def csv_row(*cells: Column) -> Column:
    """Cells quoted and joined by commas; null as an empty cell."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])


def single_report(stats: DataFrame, scores: DataFrame, style: DataFrame) -> DataFrame:
    """doc_id, section, metric, value: document metrics, score rows and the style verdict of each document, one row a metric.

    stats has one row for each doc_id; scores and style are joined by doc_id and may lack rows.
    """
    rows = stats.join(scores, "doc_id", "left").join(style, "doc_id", "left")
    parts = [("Document", c, c) for c in stats.columns if c != "doc_id"] + [("Similarity", c, c) for c in scores.columns if c != "doc_id"] + [("Style", c, c) for c in style.columns if c != "doc_id"]
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(c).cast("string").alias("value")) for s, m, c in parts])
    return rows.select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.section", "x.metric", "x.value")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_report(rows: DataFrame, key: str, title: Column, body: Column) -> DataFrame:
    """key, html: a page with a title and an escaped body."""
    return rows.select(key, F.concat(F.lit("<h1>"), escape_html(T.text_of(title)), F.lit("</h1><pre>"), escape_html(T.text_of(body)), F.lit("</pre>")).alias("html"))


def highlights(documents: DataFrame, sentence_matches: DataFrame, limit: int = 20) -> DataFrame:
    """doc_id, rank, start_pos, end_pos, colour of the first `limit` matched sentences (by similarity, then id) that stand in a
    document's text: their first place, and a colour of five in turn. Matches whose sentence isn't there have no row."""
    from pyspark.sql import Window

    one = sentence_matches.filter("sentence_a is not null").groupBy("match_id").agg(F.min(F.struct("doc_id", T.trimmed(F.col("sentence_a")).alias("s"), F.coalesce("similarity", F.lit(0.0)).alias("sim"))).alias("m")).select("match_id", "m.*")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sim"), "match_id"))).filter(F.col("rank") <= limit)
    texts = documents.groupBy("doc_id").agg(F.min(T.text_of("text")).alias("text"))
    placed = ranked.join(texts, "doc_id").withColumn("at", F.expr("locate(s, text)")).filter((F.col("at") > 0) & (F.length("s") > 0))
    return placed.select("doc_id", F.col("rank").cast("long").alias("rank"), (F.col("at") - 1).cast("long").alias("start_pos"), (F.col("at") - 1 + F.length("s")).cast("long").alias("end_pos"), ((F.col("rank") - 1) % 5).cast("long").alias("colour"))


def flagged(documents: DataFrame, sentence_matches: DataFrame) -> DataFrame:
    """doc_id, sentences, flagged: how many style sentences contain, or are contained in, a matched sentence of the document
    (lower case, letters and digits; more than 5 characters)."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    m = sentence_matches.filter("sentence_a is not null").select("doc_id", plain(F.col("sentence_a")).alias("m")).filter(F.length("m") > 5).distinct()
    s = documents.groupBy("doc_id").agg(F.min(T.text_of("text")).alias("text")).select("doc_id", F.posexplode(T.sentences_style("text")).alias("i", "s")).select("doc_id", "i", plain(F.col("s")).alias("s"))
    hit = s.filter(F.length("s") > 5).join(m, "doc_id").filter(F.contains("s", "m") | F.contains("m", "s")).select("doc_id", "i").distinct().groupBy("doc_id").agg(F.count("*").alias("flagged"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences")).join(hit, "doc_id", "left").select("doc_id", "sentences", F.coalesce("flagged", F.lit(0)).alias("flagged"))
