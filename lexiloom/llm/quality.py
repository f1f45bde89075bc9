"""Problem 2: make-up statistics of each document, and prose told from lists, tables and junk by gradient-boosted trees.

The trees see the statistics of textstats.py. They are trained on a bounded sample with weak labels that come from elsewhere:
from the forms of its lines (forms.py, which says nothing where a text is neither nearly all prose nor nearly all junk), and
from mixtures of a prose and a junk text whose shares are known. Their probabilities are then calibrated (Platt) on a
hand-checked holdout (holdout.py) that takes no part in the training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm import forms, holdout
from lexiloom.llm.codes import batches, rows_of
from lexiloom.llm.sampling import sample_texts
from lexiloom.llm.textstats import AT, NAMES, Lexicon, statistics
from lexiloom.session import spread

#: The training sample: at most so many documents of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: Mixtures of two texts of the sample, of at most so many characters each.
MIXTURES, MIXTURE_CHARS = 1500, 4000
#: A weakly labelled document is nearly all of its kind.
WEAK = 0.9
MIN_CHARS = 50
#: Most words that the table of frequent words may have; it is sent to every task.
MAX_WORDS = 100_000
#: Each tree sees a random COLUMNS of them.
TREES, DEPTH, RATE, BINS, COLUMNS = 120, 4, 0.15, 32, 0.3
#: Statistics that the trees see: all but the sizes of a text, in which mixtures differ from documents.
SEEN = [i for n, i in AT.items() if n not in ("log_chars", "words")]


class BoostedTrees:
    """Gradient-boosted regression trees on the logistic loss, with splits on quantile bins."""

    def __init__(self, depth: int = DEPTH):
        self.depth = depth
        self.features: list[np.ndarray] = []
        self.limits: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, smooth: float = 1.0, columns: float = 1.0, seed: int = 1) -> BoostedTrees:
        rng, (n, every) = np.random.default_rng(seed), x.shape
        k = max(1, int(columns * every))
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(every)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="right") for f in range(every)], axis=1)
        raw = np.zeros(n)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            some = np.sort(rng.choice(every, k, replace=False))
            offset = binned[:, some] + np.arange(k) * BINS
            node = np.zeros(n, dtype=np.int64)
            features, limits = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                for at in range(2**level):
                    rows = np.flatnonzero(node == at)
                    if len(rows) < 10:
                        continue
                    flat = offset[rows].ravel()
                    gs = np.bincount(flat, weights=np.repeat(g[rows], k), minlength=k * BINS).reshape(k, BINS).cumsum(axis=1)
                    hs = np.bincount(flat, weights=np.repeat(h[rows], k), minlength=k * BINS).reshape(k, BINS).cumsum(axis=1)
                    total, weight = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + smooth) + (total - gs) ** 2 / (weight - hs + smooth) - total**2 / (weight + smooth)
                    gain[:, -1] = 0
                    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[f, b] > 1e-6 and b < len(edges[some[f]]):
                        features[first + at], limits[first + at] = some[f], edges[some[f]][b]
                right = x[np.arange(n), features[first + node]] >= limits[first + node]
                node = 2 * node + right
            gs, hs = np.bincount(node, weights=g, minlength=2**self.depth), np.bincount(node, weights=h, minlength=2**self.depth)
            leaf = rate * gs / (hs + smooth)
            raw = raw + leaf[node]
            self.features.append(features)
            self.limits.append(limits)
            self.leaves.append(leaf)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, every = np.zeros(len(x)), np.arange(len(x))
        for features, limits, leaf in zip(self.features, self.limits, self.leaves):
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                node = 2 * node + (x[every, features[first + node]] >= limits[first + node])
            out += leaf[node]
        return out


def platt(raw: np.ndarray, y: np.ndarray, turns: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, with a weak prior on (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(turns):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((p - y) * raw).sum() + (a - 1), (p - y).sum() + b])
        hess = np.array([[(w * raw * raw).sum() + 1, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _lines(text: str) -> list[str]:
    return [x for x in text.splitlines() if x.strip()]


def _part(text: str, size: int) -> str:
    """About the first `size` characters of a text, in whole lines where they are short (for mixtures only)."""
    out, n = [], 0
    for line in _lines(text):
        if n + len(line) > size:
            if not out or len(line) > 200:
                out.append(line[: max(20, size - n)])
            break
        out.append(line)
        n += len(line)
    return "\n".join(out)


class Judge:
    """The trained trees and their calibration."""

    def __init__(self, trees: BoostedTrees, slope: float, offset: float):
        self.trees, self.slope, self.offset = trees, slope, offset

    def junk_probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.raw(x[:, SEEN]) + self.offset, -30, 30)))


def weak_labels(texts: list[str], words: list[tuple[str, str]]) -> np.ndarray:
    """0 for a text whose lines are nearly all prose, 1 where nearly none is, NaN where the lines' forms leave it open."""
    known = forms.Lexicon(words)
    found = np.array([forms.statistics(t, known)[0] for t in texts]).reshape(len(texts), len(forms.NAMES))
    prose, heading = found[:, forms.AT["prose"]], found[:, forms.AT["heading"]]
    return np.where(prose + heading >= WEAK, 0.0, np.where(prose <= 1 - WEAK, 1.0, np.nan))


def mix(good: list[str], bad: list[str], most: int, rng: np.random.Generator) -> tuple[list[str], list[float]]:
    """Texts of a part of a prose text and a part of a junk text, and whether the junk is longer."""
    texts, labels = [], []
    for share in rng.uniform(0.1, 0.9, most) if good and bad else ():
        if abs(share - 0.5) < 0.04:
            continue
        a, b = good[rng.integers(len(good))], bad[rng.integers(len(bad))]
        size = int(min(len(a) / (1 - share), len(b) / share, MIXTURE_CHARS))
        a, b = _part(a, int(size * (1 - share))), _part(b, int(size * share))
        if a and b:
            texts.append("\n\n".join((a, b) if rng.random() < 0.5 else (b, a)))
            labels.append(float(len(b) > len(a)))
    return texts, labels


def train(texts: list[str], words: list[tuple[str, str]], mixtures: int = MIXTURES, seed: int = 7) -> Judge:
    """Without a weakly labelled text of either kind nothing can be learned: every probability is then that of a coin."""
    texts = [t for t in texts if t and t.strip()]
    lexicon, weak = Lexicon(words), weak_labels(texts, words)
    good, bad = [t for t, y in zip(texts, weak) if y == 0], [t for t, y in zip(texts, weak) if y == 1]
    mixed, known = mix(good, bad, min(mixtures, 2 * len(texts)), np.random.default_rng(seed))
    x = statistics(good + bad + mixed, lexicon)[0]
    y = np.array([0.0] * len(good) + [1.0] * len(bad) + known)
    trees = BoostedTrees()
    if good and bad:
        trees.fit(x[:, SEEN], y, columns=COLUMNS)
    checked = statistics(list(holdout.PROSE + holdout.JUNK), lexicon)[0]
    return Judge(trees, *platt(trees.raw(checked[:, SEEN]), np.repeat([0.0, 1.0], [len(holdout.PROSE), len(holdout.JUNK)])))


def read_words(common_words: DataFrame) -> list[tuple[str, str]]:
    """The (language, word) rows of the table of frequent words."""
    rows = common_words.select("lang", "word").filter("lang is not null and word is not null").distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} frequent words")
    return sorted((r["lang"], r["word"]) for r in rows)


def make_up(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id, n_chars, language, the statistics of textstats.NAMES, and junk_probability of every document.

    Null, empty and blank texts have zeros, no language and a null probability. The language is that of the most frequent
    words, whatever the column lang says. Repeated rows stay repeated; other columns are ignored.
    """
    documents = documents.select("doc_id", "text")
    words = read_words(common_words)
    judge = train(sample_texts(documents, SAMPLE_DOCS, MIN_CHARS, SAMPLE_CHARS), words)
    shared = documents.sparkSession.sparkContext.broadcast((words, judge))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, judge = shared.value
        lexicon = Lexicon(known)
        for rows in batches(rows_of(stream)):
            texts = [t or "" for _, t in rows]
            x, langs = statistics(texts, lexicon)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([lang or None for lang in langs], pa.string())]
                + [pa.array(x[:, i]) for i in range(len(NAMES))] + [pa.array(judge.junk_probability(x), mask=np.array([not t.strip() for t in texts]))],
                ["doc_id", "n_chars", "language", *NAMES, "junk_probability"],
            )

    return spread(documents).mapInArrow(run, "doc_id long, n_chars long, language string, " + ", ".join(f"`{n}` double" for n in NAMES) + ", junk_probability double")


def not_prose(documents: DataFrame, common_words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id of the documents of at least min_chars characters most of whose text isn't running prose."""
    return make_up(documents, common_words).filter((F.col("n_chars") >= min_chars) & (F.col("junk_probability") >= 0.5)).select("doc_id")
