"""Problem 5: repeated content inside one document, by suffix arrays.

Documents in which no string of MIN_REPEAT characters of the normal form comes twice (found exactly by rolling hashes) have
no repeat and no need of a suffix array. Of the others, many at a time, the suffix array is made by prefix doubling in
numpy. Runs of neighbouring suffixes with a common prefix of MIN_REPEAT or more are the longest-common-prefix intervals of
the repeated substrings; the spans of all their occurrences but the first are united.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm.codes import batches, joined, normal_form, rolling, rows_of
from lexiloom.session import spread

#: Characters of the normal form that count as a repeat.
MIN_REPEAT = 20
#: Share of repeated positions from which a document is a case.
MIN_SHARE = 0.3
#: Shortest longest-repeat limit that is_repetitive() uses besides the share (none by default).
NO_LIMIT = None


def suffix_array(codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Order of all suffixes (each ends with its part), and the ranks of prefixes of doubling lengths.

    Sorted by part first. Only suffixes whose prefix isn't yet unique are sorted again.
    """
    n = len(codes)
    _, small = np.unique(codes, return_inverse=True)
    small = small.astype(np.int64) + 1
    levels: list[tuple[int, np.ndarray]] = []
    key = part.astype(np.int64) * (int(small.max(initial=0)) + 1) + small
    order = np.argsort(key, kind="stable")
    changes = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = changes
    end = np.flatnonzero(np.append(part[1:] != part[:-1], True))
    last = end[part]  # last position of the part of each suffix
    width = 1
    levels.append((width, rank))
    while True:
        # groups of equal rank that still have more than one suffix
        r = rank[order]
        same = np.concatenate([[False], r[1:] == r[:-1]])
        todo = same | np.concatenate([same[1:], [False]])
        if not todo.any():
            return order, levels
        at = np.flatnonzero(todo)
        s = order[at]
        nxt = s + width
        second = np.where(nxt <= last[s], rank[np.minimum(nxt, n - 1)] + 1, 0)
        moved = np.lexsort((second, r[at]))
        s, second, first = s[moved], second[moved], r[at]  # r[at] is sorted and lexsort keeps its order
        order[at] = s
        step = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank = rank.copy()
        # a rank is the place in the order of the first suffix of its group
        heads = np.maximum.accumulate(np.where(step, np.arange(len(s)), 0))
        if width == 1:  # ranks become places once
            place = np.empty(n, dtype=np.int64)
            place[order] = np.maximum.accumulate(np.where(~same, np.arange(n), 0))
            rank = place
        rank[s] = at[heads]
        width *= 2
        levels.append((width, rank))


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]], part: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in the order (0 across parts), by descending the levels."""
    n = len(order)
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return lcp
    end = np.flatnonzero(np.append(part[1:] != part[:-1], True))
    a, b = order[:-1].copy(), order[1:].copy()
    stop = np.where(part[a] == part[b], end[part[b]], -1)
    got = np.zeros(n - 1, dtype=np.int64)
    for width, rank in reversed(levels):
        fits = (np.maximum(a, b) + width - 1 <= stop)
        fits[fits] = rank[a[fits]] == rank[b[fits]]
        got[fits] += width
        a[fits] += width
        b[fits] += width
    lcp[1:] = got
    return lcp


def repeats(parts: list[np.ndarray], least: int = MIN_REPEAT) -> tuple[np.ndarray, np.ndarray]:
    """Of each part: how many positions lie in a string of `least` that started earlier, and the longest repeated substring
    (0 below `least`)."""
    covered, longest = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64)
    some = [i for i, p in enumerate(parts) if len(p) > least]
    if not some:
        return covered, longest
    codes, starts, part = joined([parts[i] for i in some])
    grams = rolling(codes, least)
    inside = part[: len(grams)] == part[least - 1 :]
    # the exact hash test for documents without any repeat
    mixed = grams[inside] ^ (part[: len(grams)][inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    where = part[: len(grams)][inside]
    by = np.argsort(mixed, kind="stable")
    twice = (mixed[by][1:] == mixed[by][:-1]) & (where[by][1:] == where[by][:-1])
    need = np.unique(where[by][1:][twice])
    if not len(need):
        return covered, longest
    codes, starts, part = joined([parts[some[i]] for i in need])
    order, levels = suffix_array(codes, part)
    lcp = common_prefixes(order, levels, part)
    # intervals of the order in which neighbours share `least` characters; the first occurrence stays
    linked = lcp >= least
    group = np.cumsum(~linked)
    first = np.full(group[-1] + 1, len(codes), dtype=np.int64)
    np.minimum.at(first, group, order)
    again = order[order != first[group]]
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, np.minimum(again + least, len(codes)), -1)
    hit = np.cumsum(edge[:-1]) > 0
    share = np.bincount(part, weights=hit, minlength=len(need)).astype(np.int64)
    most = np.zeros(len(need), dtype=np.int64)
    np.maximum.at(most, part[order], lcp)
    at = np.array(some)[need]
    covered[at], longest[at] = share, np.where(most >= least, most, 0)
    return covered, longest


def repetition(documents: DataFrame, least: int = MIN_REPEAT) -> DataFrame:
    """doc_id, norm_chars, repeated_chars, repeated_share, longest_repeat of every document.

    Positions and lengths are those of the normal form (lower-cased letters and numbers). A text that is null, empty or
    without letters and numbers has norm_chars 0 and share 0. Repeated rows stay repeated; other columns are ignored.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches(rows_of(stream), 400_000):
            parts = [normal_form(t) for _, t in rows]
            size = np.array([len(p) for p in parts], dtype=np.int64)
            covered, longest = repeats(parts, least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array(size), pa.array(covered), pa.array(covered / np.maximum(size, 1)), pa.array(longest)],
                ["doc_id", "norm_chars", "repeated_chars", "repeated_share", "longest_repeat"],
            )

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, norm_chars long, repeated_chars long, repeated_share double, longest_repeat long")


def repetitive(documents: DataFrame, least: int = MIN_REPEAT, min_share: float = MIN_SHARE, min_longest: int | None = NO_LIMIT) -> DataFrame:
    """doc_id of documents over the limits: a share of repeated positions of at least `min_share`, or, if `min_longest` is
    given, a repeated substring of at least that many characters."""
    rows = repetition(documents, least)
    over = rows["repeated_share"] >= min_share
    if min_longest is not None:
        over = over | (rows["longest_repeat"] >= min_longest)
    return rows.filter(over).select("doc_id")
