"""Stylometric signals of a text and the composite score of machine-like style."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import lexicon
from lexiloom.functions import text as T

#: Shortest text that is scored.
LEAST_CHARS = 50
WEIGHTS = {"uniform_length": 0.04, "low_hapax": 0.04, "transition": 0.15, "entropy": 0.20, "phrases": 0.10, "repetition": 0.05, "uniform_fog": 0.05, "zipf": 0.05, "uniformity": 0.05, "curvature": 0.27}


def _mean(a: Column) -> Column:
    return T.total(F.transform(a, lambda x: x.cast("double"))) / F.size(a)


def _variance(a: Column) -> Column:
    """Population variance."""
    return T.let(_mean(a), lambda m: T.total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def _whole(name: str, power: int) -> Column:
    """Sum of the powers of an array of integers, exactly."""
    return F.aggregate(name, F.lit(0).cast("bigint"), lambda s, x: s + (x if power == 1 else x * x))


def _count_words(s: Column) -> Column:
    return F.size(F.split(s, f"{T.SPACE}+"))


def _counted(low: Column, terms: tuple[str, ...], before: str, after: str) -> Column:
    """Matches of before + term + after in a lower-cased text, summed over the terms. Terms that the text doesn't contain (a
    plain search) never get to a regular expression."""
    there = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))
    return F.aggregate(there, F.lit(0).cast("bigint"), lambda n, t: n + F.regexp_count(low, F.concat(F.lit(before), t, F.lit(after))))


def transition_count(text: Column) -> Column:
    """Occurrences of all transition terms as whole words (letters of a-z, digits and _ make words)."""
    return T.let(F.lower(text), lambda low: _counted(low, lexicon.TRANSITIONS, "(?<![a-zA-Z0-9_])", "(?![a-zA-Z0-9_])"))


def signals(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), more: dict[str, Column] | None = None) -> DataFrame:
    """keep and all signals, unrounded, from the text in `text`: row-local, without an exchange. `more` names further
    expressions over the columns text and tok (its tokens).

    Short texts have the fixed defaults of each signal. Tokens and sentences are made once and reused.
    """
    t = T.text_of("text")
    base = documents.select(*keep, t.alias("text"), T.tokens_style("text").alias("tok"), T.sentences_style("text").alias("sent"))
    base = base.select("*", F.transform("sent", _count_words).alias("len"), T.counts(F.col("tok")).alias("cnt"), F.transform("tok", lambda x: F.length(x)).alias("wl"), F.transform("sent", lambda s: F.lower(F.get(F.split(s, f"{T.SPACE}+"), 0))).alias("starters"))
    n, ns = F.size("tok"), F.size("sent")
    nd = n.cast("double")
    entropy = -T.total(F.transform("cnt", lambda c: c / nd * F.log2(c / nd)))
    top10 = F.aggregate(F.slice(F.reverse(F.array_sort("cnt")), 1, 10), F.lit(0).cast("bigint"), lambda a, b: a + b) / nd
    cv = F.sqrt(_variance(F.col("len"))) / _mean(F.col("len"))
    fog = 0.4 * (nd / ns + 100 * (F.size(F.filter("wl", lambda x: x > 7)) / nd))
    empty = n == 0
    return base.select(
        *keep, *[c.alias(name) for name, c in (more or {"text": F.col("text")}).items()], n.cast("long").alias("tokens"), ns.cast("long").alias("sentences"),
        F.when(ns < 3, 0.5).otherwise(F.least(cv, F.lit(1.5)) / 1.5).alias("burstiness"),
        F.when(empty, 0.0).otherwise(F.size("cnt") / nd).alias("ttr"),
        F.when(empty, 0.0).otherwise(F.size(F.filter("cnt", lambda c: c == 1)) / nd).alias("hapax"),
        F.when(n < 10, 0.5).when(F.size("cnt") <= 1, 0.0).otherwise(entropy / F.log2(F.size("cnt").cast("double"))).alias("entropy"),
        F.when(ns == 0, 0.0).otherwise(F.least(transition_count(F.col("text")) / ns, F.lit(2.0)) / 2).alias("transition"),
        F.when(empty, 0.0).otherwise(_mean(F.col("wl"))).alias("word_length"),
        F.when(empty, 0.0).otherwise((n * _whole("wl", 2) - _whole("wl", 1) * _whole("wl", 1)).cast("double") / (nd * nd)).alias("word_length_var"),
        F.when(empty, 0.0).otherwise(F.size(F.filter("wl", lambda x: x > 8)) / nd).alias("long_words"),
        F.when(ns < 4, 0.0).otherwise(F.array_max(T.counts(F.col("starters"))) / ns).alias("repetition"),
        F.when((ns == 0) | empty, 0.5).otherwise(F.least(F.abs(fog - 13) / 8, F.lit(1.0))).alias("fog"),
        F.when(empty, 0.5).when(top10 > 0.28, 0.65).when(top10 < 0.15, 0.25).otherwise(0.5).alias("zipf"),
        F.when(ns == 0, 0.0).otherwise(F.least(F.size(F.filter("len", lambda x: (x >= 12) & (x <= 28))) / ns * 1.2, F.lit(1.0))).alias("uniformity"),
    )


SIGNALS = ("burstiness", "ttr", "hapax", "entropy", "transition", "word_length", "word_length_var", "long_words", "repetition", "fog", "zipf", "uniformity")


def style_signals(documents: DataFrame) -> DataFrame:
    """doc_id, tokens, sentences and the signals (3 digits) of every document."""
    return signals(documents).select("doc_id", "tokens", "sentences", *[T.rounded(F.col(c), 3).alias(c) for c in SIGNALS])


def punctuation(documents: DataFrame) -> DataFrame:
    """doc_id, comma_rate, semicolons, comma_uniformity: commas per piece between white space."""
    t = T.text_of("text")
    rate = F.regexp_count(t, F.lit(",")) / _count_words(t)
    return documents.select("doc_id", T.rounded(rate, 3).alias("comma_rate"), F.regexp_count(t, F.lit(";")).cast("long").alias("semicolons"), T.rounded(F.least(rate / 0.15, F.lit(1.0)), 3).alias("comma_uniformity"))


def marker_phrases(documents: DataFrame) -> DataFrame:
    """doc_id, n, phrases: the marker phrases in a text, in their own order, joined by ' | '."""
    found = T.let(F.lower(T.text_of("text")), lambda low: F.filter(F.array(*[F.lit(p) for p in lexicon.MARKERS]), lambda p: F.contains(low, p)))
    return documents.select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, " | ").alias("phrases"))


def _signature(text: Column) -> Column:
    """Scores by signature: overlapping occurrences of its phrases, and half a point for each of its transitions."""

    def scores(low: Column) -> Column:
        half = lambda terms: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))) / 2
        return F.array(*[_counted(low, phrases, "(?=", ")") + half(transitions) for _, phrases, transitions in lexicon.SIGNATURES])

    return T.let(F.lower(text), scores)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, model, confidence, total: whose phrases a text has most of; null and 0 if the total is below 2. Ties take the
    first in the declared order."""
    rows = documents.select("doc_id", _signature(T.text_of("text")).alias("s")).select("doc_id", "s", F.array_max("s").alias("top"), T.total(F.col("s")).alias("total"))
    sure = (F.col("top") > 0) & (F.col("total") >= 2)
    names = F.array(*[F.lit(n) for n, _, _ in lexicon.SIGNATURES])
    return rows.select("doc_id", F.when(sure, F.element_at(names, F.array_position("s", F.col("top")).cast("int"))).alias("model"), F.when(sure, T.rounded(F.col("top") / F.greatest(F.col("total"), F.lit(1.0)), 3)).otherwise(0.0).alias("confidence"), "total")


def curvature_of(tokens: list[list[str]]) -> np.ndarray:
    """min(2.5 x population variance of the 10-token rolling mean of log2(p + 0.0001), 3.5); NaN below 20 tokens."""
    out = np.full(len(tokens), np.nan)
    for i, t in enumerate(tokens):
        if len(t) >= 20:
            _, inverse, count = np.unique(np.array(t), return_inverse=True, return_counts=True)
            logs = np.log2(count[inverse] / len(t) + 0.0001)
            out[i] = min(np.lib.stride_tricks.sliding_window_view(logs, 10).mean(axis=1).var() * 2.5, 3.5)
    return out


def with_curvature(rows: DataFrame) -> DataFrame:
    """The rows with the curvature of the tokens in `tok` in place of these. In Arrow batches: a rolling window over token
    frequencies would otherwise need every token of the corpus exchanged."""
    kept = [f for f in rows.schema if f.name != "tok"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", curvature double"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                c = curvature_of(part.column("tok").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(c, mask=np.isnan(c))], [*(f.name for f in kept), "curvature"])

    return rows.mapInArrow(run, schema)


def _likelihood(c: Column) -> Column:
    return F.when(c > 2.5, 0.9).when(c > 1.8, 0.6).when(c > 1.0, 0.3).otherwise(0.05)


def curvature(documents: DataFrame) -> DataFrame:
    """doc_id, curvature, likelihood of every document; 0 and 0 below 20 tokens."""
    return with_curvature(documents.select("doc_id", T.tokens_style("text").alias("tok"))).select("doc_id", F.coalesce(T.rounded(F.col("curvature"), 2), F.lit(0.0)).alias("curvature"), F.when(F.col("curvature").isNull(), 0.0).otherwise(_likelihood(T.rounded(F.col("curvature"), 9))).alias("likelihood"))


def style_variance(documents: DataFrame) -> DataFrame:
    """doc_id, variance, multi_author, yules_k, grade: how much word length, grade and Yule's K vary over chunks of four
    sentences. Below 8 sentences: 0, false, 0 and null."""
    base = documents.select("doc_id", T.sentences_style("text").alias("sent"))
    parts = base.select("doc_id", F.size("sent").alias("n"), F.explode_outer(F.when(F.size("sent") >= 8, T.style_chunks(F.col("sent")))).alias("chunk"))
    tok = parts.select("doc_id", "n", T.tokens_style("chunk").alias("tok"), F.size(T.sentences_style("chunk")).alias("ns"))
    size = F.size("tok")
    some = F.greatest(size, F.lit(1)).cast("double")
    syllables = T.total(F.transform("tok", lambda x: F.greatest(F.lit(1.0), F.floor(F.length(x) / 3).cast("double"))))
    squares = T.total(F.transform(T.counts(F.col("tok")), lambda c: (c * c).cast("double")))
    vectors = tok.select(
        "doc_id", "n", (T.total(F.transform("tok", lambda x: F.length(x).cast("double"))) / some).alias("awl"),
        (0.39 * (size / F.greatest(F.col("ns"), F.lit(1))) + 11.8 * (syllables / some) - 15.59).alias("fk"),
        F.when(size > 1, 10000 * (squares - size) / (some * some)).otherwise(0.0).alias("yk"))
    g = vectors.groupBy("doc_id", "n").agg(*[f(c).alias(f"{k}_{c}") for c in ("awl", "fk", "yk") for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    score = F.least(F.col("s_awl") / 2 * 0.3 + F.col("s_fk") / 4 * 0.4 + F.col("s_yk") / 100 * 0.3, F.lit(1.0))
    enough = F.col("n") >= 8
    return g.select("doc_id", F.when(enough, T.rounded(score, 3)).otherwise(0.0).alias("variance"), (enough & (T.rounded(score, 9) > 0.45)).alias("multi_author"), F.when(enough, T.rounded(F.col("m_yk"), 1)).otherwise(0.0).alias("yules_k"), F.when(enough, T.rounded(F.col("m_fk"), 1)).alias("grade"))


def scored(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, pct, verdict, certainty, confidence of the text in `text`: row-local, in one pass. What is passed on from
    step to step are numbers, not texts."""
    phrases = T.let(F.lower(F.col("text")), lambda low: F.size(F.filter(F.array(*[F.lit(p) for p in lexicon.MARKERS]), lambda p: F.contains(low, p))))
    rows = with_curvature(signals(documents, keep, {"tok": F.col("tok"), "n_phrases": phrases, "made": _signature(F.col("text")), "long": F.length("text") >= LEAST_CHARS}))
    rows = rows.withColumn("top", F.array_max("made")).withColumn("sum", T.total(F.col("made")))
    parts = {
        "uniform_length": 1 - F.col("burstiness"), "low_hapax": 1 - F.col("hapax"), "transition": F.col("transition"), "entropy": F.col("entropy"), "phrases": F.least(F.col("n_phrases") / 2, F.lit(1.0)),
        "repetition": F.col("repetition"), "uniform_fog": 1 - F.col("fog"), "zipf": F.col("zipf"), "uniformity": F.col("uniformity"),
        "curvature": F.when(F.col("curvature").isNull(), 0.0).otherwise(_likelihood(T.rounded(F.col("curvature"), 9)))}
    score = F.least(F.greatest(sum(parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0)), F.lit(1.0))
    sure = F.when((F.col("top") > 0) & (F.col("sum") >= 2), T.rounded(F.col("top") / F.greatest(F.col("sum"), F.lit(1.0)), 3)).otherwise(0.0)
    rows = rows.select(*keep, "long", sure.alias("confidence"), score.alias("raw"))
    final = F.least(F.col("raw") + F.when(F.col("confidence") > 0.4, F.col("confidence") * 0.08).otherwise(0.0), F.lit(1.0))
    s, long = F.col("s"), F.col("long")
    return rows.select(*keep, "long", "confidence", T.rounded(final, 9).alias("s")).select(
        *keep, F.when(long, T.rounded(s, 4)).otherwise(0.0).alias("score"), F.when(long, T.percent(s)).otherwise(0).cast("long").alias("pct"),
        F.when(~long, "Unknown").when(s >= 0.70, "Likely AI-Generated").when(s >= 0.45, "Mixed / Uncertain").when(s >= 0.25, "Likely Human-Written").otherwise("Human-Written").alias("verdict"),
        F.when(~long, "Low").when((s >= 0.25) & (s < 0.70), "Medium Confidence").otherwise("High Confidence").alias("certainty"), "confidence")


def once(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each key: of several the smallest by its columns. Null keys have none."""
    rest = [c for c in rows.columns if c != key]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def machine_style(documents: DataFrame) -> DataFrame:
    """doc_id, score, pct, verdict, certainty: the weighted signals, raised by a sure phrase signature. Texts below 50
    characters: 0, 0, 'Unknown', 'Low'. One row per doc_id: repeated rows count once, of different texts the smaller score;
    only these numbers are exchanged."""
    return once(scored(documents.select("doc_id", "text")).drop("confidence"))
