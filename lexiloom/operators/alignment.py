"""Longest common subsequence and local alignment of two token lists, as Arrow functions (dynamic programmes have no
DataFrame form). The length uses big integers as bit vectors; the other two have fixed limits on their input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators.pairs import checks

#: Tokens of either side that sequences and local alignments look at, and the local alignment's scores.
SEQUENCE_TOKENS, LOCAL_TOKENS = 500, 300
MATCH, MISMATCH, GAP, LEAST_SCORE, LEAST_TOKENS, MOST = 2, -1, 1, 6, 3, 10


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a row of the table is one integer whose zero bits mark the steps."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def _ids(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    return tuple(np.array([ids.setdefault(t, len(ids)) for t in x], dtype=np.int64) for x in (a, b))  # type: ignore[return-value]


def lcs_words(a: list[str], b: list[str], most: int | None = SEQUENCE_TOKENS) -> list[str]:
    """The subsequence that backtracking finds: a step up only where the cell above is larger, else to the left."""
    a, b = a[:most], b[:most]
    if not a or not b:
        return []
    x, y = _ids(a, b)
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i in range(1, len(a) + 1):
        same = x[i - 1] == y
        table[i, 1:] = np.maximum.accumulate(np.maximum(table[i - 1, 1:], np.where(same, table[i - 1, :-1] + 1, 0)))
    out, i, j = [], len(a), len(b)
    while i and j:
        if x[i - 1] == y[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1, j] > table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def local_alignments(a: list[str], b: list[str], most: int | None = LOCAL_TOKENS) -> list[dict]:
    """Up to ten local alignments by falling score that start where no earlier one has passed."""
    a, b = a[:most], b[:most]
    if not a or not b:
        return []
    x, y = _ids(a, b)
    n = len(b)
    h = np.zeros((len(a) + 1, n + 1), dtype=np.int32)
    step = np.arange(n, dtype=np.int32) * GAP
    for i in range(1, len(a) + 1):
        free = np.maximum(np.maximum(h[i - 1, :-1] + np.where(x[i - 1] == y, MATCH, MISMATCH), h[i - 1, 1:] - GAP), 0)
        h[i, 1:] = np.maximum.accumulate(free + step) - step  # gaps along the row
    rows, cols = np.nonzero(h >= LEAST_SCORE)
    order = np.argsort(-h[rows, cols], kind="stable")
    used_i, used_j, out = set(), set(), []
    for i, j in zip(rows[order].tolist(), cols[order].tolist()):
        if i in used_i or j in used_j:
            continue
        score, tokens = int(h[i, j]), []
        while i and j and h[i, j] > 0:
            same = x[i - 1] == y[j - 1]
            if same:
                tokens.append(a[i - 1])
            used_i.add(i)
            used_j.add(j)
            if h[i, j] == h[i - 1, j - 1] + (MATCH if same else MISMATCH):
                i, j = i - 1, j - 1
            elif h[i, j] == h[i - 1, j] - GAP:
                i -= 1
            else:
                j -= 1
        if len(tokens) >= LEAST_TOKENS:
            out.append({"phrase": " ".join(tokens[::-1]), "length": len(tokens), "pos_a": i, "pos_b": j, "score": score})
        if len(out) >= MOST:
            break
    return out


_LOCAL = pa.list_(pa.struct([("phrase", pa.string()), ("length", pa.int64()), ("pos_a", pa.int64()), ("pos_b", pa.int64()), ("score", pa.int64())]))


def _aligned(pairs: DataFrame, key: str, parts: tuple[str, ...], words: int | None = SEQUENCE_TOKENS, local: int | None = LOCAL_TOKENS) -> DataFrame:
    """key, na, nb and the named parts (length, words, local) of the token lists of a and b; of the latter two, of so many
    tokens (None: all)."""
    kinds = {
        "length": (pa.int64(), "bigint", lcs_length),
        "words": (pa.list_(pa.string()), "array<string>", lambda a, b: lcs_words(a, b, words)),
        "local": (_LOCAL, "array<struct<phrase:string,length:bigint,pos_a:bigint,pos_b:bigint,score:bigint>>", lambda a, b: local_alignments(a, b, local)),
    }
    rows = pairs.select(key, T.tokens_all("a").alias("ta"), T.tokens_all("b").alias("tb"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 200):
                p = batch.slice(at, 200)
                both = list(zip(p.column("ta").to_pylist(), p.column("tb").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [p.column(key), pa.array([len(a) for a, _ in both], pa.int64()), pa.array([len(b) for _, b in both], pa.int64()), *(pa.array([kinds[k][2](a, b) for a, b in both], kinds[k][0]) for k in parts)], [key, "na", "nb", *parts])

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, na bigint, nb bigint, " + ", ".join(f"`{k}` {kinds[k][1]}" for k in parts))


def _similarity() -> F.Column:
    return F.when((F.col("na") == 0) | (F.col("nb") == 0), 0.0).otherwise(F.least(F.col("length") / F.greatest("na", "nb", F.lit(1)), F.lit(1.0)))


def similarity(single_checks: DataFrame) -> DataFrame:
    """check_id, lcs, similarity, pct; 0 if either text has no token."""
    s = _similarity()
    return _aligned(checks(single_checks), "check_id", ("length",)).select("check_id", F.col("length").alias("lcs"), T.rounded(s, 4).alias("similarity"), T.percent(s).alias("pct"))


def words(single_checks: DataFrame, most: int | None = SEQUENCE_TOKENS) -> DataFrame:
    """check_id, n, words: the common subsequence of the first `most` tokens (None: of all)."""
    return _aligned(checks(single_checks), "check_id", ("words",), words=most).select("check_id", F.size("words").cast("long").alias("n"), F.array_join("words", " ").alias("words"))


def local(single_checks: DataFrame, most: int | None = LOCAL_TOKENS) -> DataFrame:
    """check_id, rank, phrase, length, pos_a, pos_b, score of the local alignments of the first `most` tokens (None: of all)."""
    return _aligned(checks(single_checks), "check_id", ("local",), local=most).select("check_id", F.posexplode("local").alias("rank", "l")).select("check_id", (F.col("rank") + 1).cast("long").alias("rank"), "l.*")


def report(single_checks: DataFrame) -> DataFrame:
    """check_id, similarity, pct, alignments, sequences (all of them, by rank: phrase and score), lcs_words, preview (the first
    30 words of the subsequence)."""
    s = _similarity()
    sequences = F.array_join(F.transform("local", lambda x: F.concat(x["phrase"], F.lit(" ("), x["score"].cast("string"), F.lit(")"))), " | ")
    return _aligned(checks(single_checks), "check_id", ("length", "words", "local")).select(
        "check_id", T.rounded(s, 4).alias("similarity"), T.percent(s).alias("pct"), F.size("local").cast("long").alias("alignments"), sequences.alias("sequences"),
        F.size("words").cast("long").alias("lcs_words"), F.array_join(F.slice("words", 1, 30), " ").alias("preview"))


def one_against_many(target: DataFrame | str, references: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """key, similarity, sequences of one text (a string, or the only row of a frame, column text) with each text of a table, by
    falling similarity: that of the common subsequence, and the `most` best local alignments. No target: no rows."""
    if isinstance(target, str):
        rows = references.select(key, F.lit(target).alias("a"), T.text_of(text).alias("b"))
    else:  # one row by its definition: sent to every task
        one = target.limit(1).select(T.text_of("text").alias("a"), F.lit(1).alias("one"))
        rows = references.select(key, T.text_of(text).alias("b"), F.lit(1).alias("one")).join(F.broadcast(one), "one").select(key, "a", "b")
    sequences = F.array_join(F.transform(F.slice("local", 1, most), lambda x: x["phrase"]), " | ")
    return _aligned(rows, key, ("length", "local")).select(key, T.rounded(_similarity(), 4).alias("similarity"), sequences.alias("sequences")).orderBy(F.desc("similarity"), key)
