"""Problem 9: keyword-stuffed, link-list and tag pages, by robust Mahalanobis distances.

Each document is a point of ten coordinates: density (length of the items between separators, separators, marks, symbols,
digits), entropy, repetition (variety of terms, terms that come again) and function words, and the length of words. Centre and
scatter are estimated per language over all documents, robustly: medians, median absolute deviations, and the scatter of sums
and differences of each pair of coordinates (Gnanadesikan-Kettenring); languages of few documents are shrunk towards all.

An outlier is a document beyond a quantile of the distance. It is flagged if it lies in a spam-directed direction: the way its
statistics differ from the ordinary pages of its language, whatever the length of that way, is on the spam side of a plane that
is estimated (maximum entropy) from weakly labelled outliers, a bounded sample, and the labelled texts of holdout.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import forms, holdout
from lexiloom.llm.codes import batches, rows_of
from lexiloom.llm.quality import read_words
from lexiloom.llm.textstats import AT, NAMES, Lexicon, statistics
from lexiloom.session import spread, stored

COORDINATES = ("item", "separators", "marks", "symbols", "digits", "entropy", "variety", "common", "mean_word", "repeated")
#: Statistics whose deviations make the direction: all but the sizes of a text.
TOLD = np.array([i for n, i in AT.items() if n not in ("log_chars", "words")])
#: Square root of the 0.999 quantile of chi-square with ten degrees of freedom.
OUTLIER = 5.44
#: The scatter of all documents counts as much as so many documents of the language; least eigenvalue of a correlation.
PRIOR_DOCS, LEAST_EIGEN = 200, 0.1
#: Weakly labelled outliers that the plane is fitted on, on average, and the share of the text that must be (or not be) spam.
SAMPLE_OUTLIERS, SURE = 5000, 0.1
#: Weight of the prior of the plane; relative error of the quantile sketches is its inverse.
PRIOR, ACCURACY = 0.01, 200
#: Forms of lines that are spam.
SPAM_FORMS = ("link", "product", "tags", "keywords")


def coordinates(v: np.ndarray) -> np.ndarray:
    """The points of rows of text statistics."""
    c = lambda name: v[..., AT[name]]
    return np.stack([np.log1p(c("item_words")), np.log1p(c("commas") + c("bars")), c("marks"), c("symbols"), c("digits"), c("entropy"), c("variety"), c("common"), c("mean_word"), c("repeated_words")], axis=-1)


def points(documents: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    """doc_id, language, the statistics (packed) and the coordinates of every document that isn't null or blank."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for rows in batches((k, t) for k, t in rows_of(stream) if t and t.strip()):
            v, langs = statistics([t for _, t in rows], lexicon)
            x = coordinates(v)
            packed = [r.tobytes() for r in v.astype(np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(langs, pa.string()), pa.array(packed, pa.binary()), *(pa.array(x[:, i]) for i in range(len(COORDINATES)))], ["doc_id", "language", "stats", *COORDINATES])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, language string, stats binary, " + ", ".join(f"{n} double" for n in COORDINATES))


def _median(c) -> F.Column:
    return F.percentile_approx(c, F.lit(0.5), F.lit(ACCURACY))


def scatter(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language ("" of all documents, also for texts without a language): robust centre and inverse scatter. Medians over
    all rows, by mergeable sketches; what comes to the driver is one row per language of the lexicon."""
    both = rows.withColumn("group", F.explode(F.array_distinct(F.array("language", F.lit(""))))).select("group", *COORDINATES)
    centres = both.groupBy("group").agg(F.count("*").alias("n"), *[_median(F.col(f)).alias(f) for f in COORDINATES]).collect()
    if not centres:
        return {}
    # a table of one row per language of the lexicon, whose size is bounded by MAX_WORDS
    known = rows.sparkSession.createDataFrame([(r["group"], *(r[f] for f in COORDINATES)) for r in centres], "group string, " + ", ".join(f"m_{f} double" for f in COORDINATES))
    around = both.join(F.broadcast(known), "group").select("group", *[(F.col(f) - F.col(f"m_{f}")).alias(f) for f in COORDINATES])
    # units of all documents, so that sums and differences of coordinates are of comparable ones
    whole = around.filter("group = ''").agg(*[_median(F.abs(F.col(f))).alias(f) for f in COORDINATES]).first()
    unit = np.array([1.4826 * whole[f] for f in COORDINATES])
    if not unit.all():  # rows that are all alike: any unit will do
        unit = np.where(unit > 0, unit, 1.0)
    pairs = list(combinations(range(len(COORDINATES)), 2))
    z = [F.col(f) / F.lit(float(u)) for f, u in zip(COORDINATES, unit)]
    spreads = around.groupBy("group").agg(*[_median(F.abs(c)).alias(f"s{i}") for i, c in enumerate(z)], *[_median(F.abs(z[i] + z[j])).alias(f"p{i}_{j}") for i, j in pairs], *[_median(F.abs(z[i] - z[j])).alias(f"d{i}_{j}") for i, j in pairs])
    own: dict[str, np.ndarray] = {}
    for r in spreads.collect():
        c = np.diag([(1.4826 * r[f"s{i}"]) ** 2 for i in range(len(COORDINATES))])
        for i, j in pairs:
            c[i, j] = c[j, i] = 1.4826**2 * (r[f"p{i}_{j}"] ** 2 - r[f"d{i}_{j}"] ** 2) / 4
        own[r["group"]] = c
    out = {}
    for r in centres:
        n = r["n"]
        c = own[""] if not r["group"] else (n * own[r["group"]] + PRIOR_DOCS * own[""]) / (n + PRIOR_DOCS)
        d = np.sqrt(np.diag(c))
        d = np.where(d > 0, d, 1.0)
        values, vectors = np.linalg.eigh(c / np.outer(d, d))
        c = (vectors * np.maximum(values, LEAST_EIGEN)) @ vectors.T * np.outer(d * unit, d * unit)
        out[r["group"]] = (np.array([r[f] for f in COORDINATES]), np.linalg.inv(c))
    return out


def whitened(x: np.ndarray, langs: np.ndarray, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The points from the centre of their language, in its metric: their lengths are Mahalanobis distances."""
    out = np.zeros_like(x)
    for lang in set(langs.tolist()):
        at = np.flatnonzero(langs == lang)
        centre, inverse = known.get(lang) or known[""]
        out[at] = (x[at] - centre) @ np.linalg.cholesky(inverse)
    return out


class Ordinary:
    """Mean statistics of the documents of each language that are no outliers, and the spread of each statistic over all."""

    def __init__(self, means: dict[str, np.ndarray], spread: np.ndarray):
        self.means, self.spread = means, np.where(spread > 0, spread, 1.0)

    @classmethod
    def of(cls, rows: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[Ordinary, int]:
        """Of all rows, by sums; and the number of outliers. The driver gets a row per language and statistic."""

        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for v, x, langs in _read(stream):
                inlier = np.linalg.norm(whitened(x, langs, known), axis=1) < OUTLIER
                one = np.ones(v.shape[1])
                for lang in set(langs.tolist()):
                    at = langs == lang
                    near = v[at & inlier]
                    sums[lang] = sums.get(lang, 0) + np.stack([near.sum(axis=0), len(near) * one, v[at].sum(axis=0), (v[at] ** 2).sum(axis=0), at.sum() * one])
            out = [(lang, i, *s[:, i].tolist()) for lang, s in sums.items() for i in range(len(NAMES))]
            kinds = (pa.string(), pa.int32(), *[pa.float64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], ["language", "i", "s", "n", "t", "q", "m"])

        found = rows.mapInArrow(run, "language string, i int, s double, n double, t double, q double, m double").groupBy("language", "i").agg(*[F.sum(c).alias(c) for c in "sntqm"]).collect()
        means: dict[str, np.ndarray] = {}
        all_ = np.zeros((5, len(NAMES)))
        for r in found:
            all_[:, r["i"]] += [r[c] for c in "sntqm"]
            if r["language"] and r["n"]:
                means.setdefault(r["language"], np.zeros(len(NAMES)))[r["i"]] = r["s"] / r["n"]
        s, n, t, q, m = all_
        means[""] = s / np.maximum(n, 1)
        variance = q / np.maximum(m, 1) - (t / np.maximum(m, 1)) ** 2
        return cls(means, np.sqrt(np.maximum(variance, 0))), int(m.max(initial=0) - n.max(initial=0))

    def direction(self, v: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Unit vectors of the (square roots of the) deviations from the ordinary pages of the language."""
        centre = np.stack([self.means[k] if k in self.means else self.means[""] for k in langs.tolist()]) if len(v) else v
        away = ((v - centre) / self.spread)[:, TOLD]
        away = np.sign(away) * np.sqrt(np.abs(away))
        return away / np.maximum(np.linalg.norm(away, axis=1), 1e-9)[:, None]


def sides(v: np.ndarray, z: np.ndarray, langs: np.ndarray, ordinary: Ordinary) -> np.ndarray:
    """What a plane sees of a direction: the deviations, and the products of the whitened coordinates, both of length one."""
    u = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    i, j = np.tril_indices(z.shape[1])
    return np.hstack([np.ones((len(v), 1)), ordinary.direction(v, langs), u[:, i] * u[:, j]])


def fit_plane(x: np.ndarray, y: np.ndarray, prior: float = PRIOR, turns: int = 50) -> np.ndarray:
    """Logistic regression (Newton steps); zeros, which flag nothing, if there is only one kind of row."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return w
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(len(w)), x.T @ (p - y) + prior * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _read(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in stream:
        if batch.num_rows:
            yield _columns(batch)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(batch.column("stats").to_pylist()), dtype=np.float32).reshape(batch.num_rows, len(NAMES)).astype(np.float64)
    return v, np.stack([batch.column(f).to_numpy() for f in COORDINATES], axis=1), np.array(batch.column("language").to_pylist(), dtype=object)


def _labelled(documents: DataFrame, words: list[tuple[str, str]], known: dict, ordinary: Ordinary, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sides and labels (1 spam) of a hash sample of the outliers. Texts stay in the tasks; the driver gets the numbers."""
    shared = documents.sparkSession.sparkContext.broadcast((words, known, ordinary))
    picked = documents.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))) if share < 1 else documents

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known, ordinary = shared.value
        lexicon, kinds = Lexicon(words), forms.Lexicon(words)
        for rows in batches((k, t) for k, t in rows_of(stream) if t and t.strip()):
            texts = [t for _, t in rows]
            v, langs = statistics(texts, lexicon)
            langs = np.array(langs, dtype=object)
            z = whitened(coordinates(v), langs, known)
            out = np.flatnonzero(np.linalg.norm(z, axis=1) >= OUTLIER)
            shares = np.array([sum(forms.statistics(texts[i], kinds)[0][forms.AT[f]] for f in SPAM_FORMS) for i in out])
            sure = np.abs(shares - 0.5) >= SURE
            x = sides(v[out], z[out], langs[out], ordinary)[sure].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array((shares[sure] >= 0.5).astype(np.int32))], ["x", "y"])

    found = spread(picked.select("doc_id", "text")).mapInArrow(run, "x binary, y int").toArrow()
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), dtype=np.float32).reshape(found.num_rows, -1) if found.num_rows else np.empty((0, 0), np.float32)
    return x.astype(np.float64), found.column("y").to_numpy().astype(np.float64)


def judged(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, language, distance, spam_side, is_spam of every document; null and blank texts have no row.

    spam_side is above 0 on the spam side of the plane, whatever the distance. The language is found from the text, not read
    from the column lang. Repeated rows stay repeated.
    """
    documents = documents.select("doc_id", "text")
    words = read_words(common_words)
    rows = stored(points(documents, words))
    known = scatter(rows)
    plane, ordinary = np.zeros(0), None
    if known:
        ordinary, outliers = Ordinary.of(rows, known)
        x, y = _labelled(documents, words, known, ordinary, SAMPLE_OUTLIERS / max(outliers, 1))
        # texts labelled by hand, so that there are directions in a small collection too
        v, langs = statistics(list(holdout.SPAM + holdout.NO_SPAM), Lexicon(words))
        langs = np.array(langs, dtype=object)
        own = sides(v, whitened(coordinates(v), langs, known), langs, ordinary)
        mine = np.repeat([1.0, 0.0], [len(holdout.SPAM), len(holdout.NO_SPAM)])
        plane = fit_plane(np.vstack([x, own]) if len(y) else own, np.concatenate([y, mine]))
    shared = documents.sparkSession.sparkContext.broadcast((known, ordinary, plane))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ordinary, plane = shared.value
        for batch in stream:
            if batch.num_rows:
                v, x, langs = _columns(batch)
                z = whitened(x, langs, known)
                distance, side = np.linalg.norm(z, axis=1), sides(v, z, langs, ordinary) @ plane
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("language"), pa.array(distance), pa.array(side), pa.array((distance >= OUTLIER) & (side > 0))], ["doc_id", "language", "distance", "spam_side", "is_spam"])

    return rows.mapInArrow(run, "doc_id long, language string, distance double, spam_side double, is_spam boolean")


def spam_pages(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id of the pages of stuffed keywords, links or tags."""
    return judged(documents, common_words).filter("is_spam").select("doc_id")
