"""Problem 3: near-duplicate records, by banded signatures and sequential Bayesian verification.

Records with one normal form are one class (its id is a 64-bit hash of the normal form); all work is on classes.

1. One pass over the texts makes, per record, the class, BANDS keys of ROWS min-hash values each, and a sketch of one byte
   per hash. The min-hashes come from a fast similarity sketch (Dahlgaard, Knudsen, Thorup 2017): a string is hashed once a
   round into one of K bins, and further rounds only fill bins that are still empty.
2. Classes that share a key are candidates. Keys are exchanged with the first HEAD bytes of the sketch, GROUP bands at a time
   (a group's shuffle files are deleted before the next one); a task reads them in sorted order, a run of equal keys at a
   time. Runs of up to HOT_BUCKET classes are compared at once; longer runs are cut into blocks, and block pairs become
   tasks of bounded size.
3. A candidate's sketches are compared a batch of hashes at a time. It is dropped as soon as the posterior probability that
   its similarity reaches the threshold (uniform prior) is below MISS. The first batches are compared where the candidate is
   found, before anything is emitted: candidates grow with the square of the records, what is left of them hardly does.
4. Survivors are verified exactly on their texts.

No link between different texts is lost but by the bands (1 - (1 - s^ROWS)^BANDS at similarity s) and MISS.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.codes import batches, joined, mix, normal_form, rolling, rows_of
from lexiloom.session import apart, cores, drop, moved, spread, stored

#: Characters of a string of the normal form whose set makes the similarity.
SHINGLE = 12
MIN_CHARS = 200
THRESHOLD = 0.5
#: Chance of a candidate: 0.9998 at similarity 0.5, 0.99999 at 0.55.
ROWS, BANDS = 3, 64
BINS = ROWS * BANDS
#: Hashes compared by the Bayesian test, in batches; posterior probability below which a candidate is dropped.
SKETCH, BATCH, MISS = 96, 16, 1e-3
#: Bytes of a sketch that go with each key (whole batches), and bands whose keys are exchanged at a time.
HEAD, GROUP = 64, 8
#: Classes of one key that are compared at once; beyond, blocks of HOT_BLOCK classes.
HOT_BUCKET, HOT_BLOCK = 4096, 4096
#: Runs of up to so many classes are compared many at a time, in steps of so many pairs.
SHORT_RUN, STEP_PAIRS = 32, 1_000_000
#: Rounds of the fast sketch before the rest is filled directly (records of few distinct strings).
ROUNDS = 10
#: Classes a task remembers, to make the keys of copies only once.
SEEN = 200_000


def signatures(hashes: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Min-hashes (records x bins) of the hash sets, none of them empty. Equal values at a bin with probability similarity."""
    values, _, part = joined(hashes)
    values = values.astype(np.uint64)
    n = len(hashes)
    sig = np.full(n * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    todo = np.arange(len(values))
    for turn in range(ROUNDS):
        h = mix(values[todo], turn + 1)
        at = part[todo] * bins + ((h >> np.uint64(40)) % np.uint64(bins)).astype(np.int64)
        # the round is the top part of the value: a later round never replaces an earlier one
        np.minimum.at(sig, at, (np.uint64(turn) << np.uint64(56)) | (mix(h, 99) >> np.uint64(8)))
        open_ = (sig == np.iinfo(np.uint64).max).reshape(n, bins).any(axis=1)
        todo = todo[open_[part[todo]]]
        if not len(todo):
            break
    sig = sig.reshape(n, bins)
    if len(todo):
        for i in np.unique(part[todo]):
            own = np.unique(values[part == i])
            empty = np.flatnonzero(sig[i] == np.iinfo(np.uint64).max)
            for b in empty:
                sig[i, b] = (np.uint64(ROUNDS) << np.uint64(56)) | (mix(own, 1000 + int(b)).min() >> np.uint64(8))
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    keys = []
    for b in range(sig.shape[1] // rows):
        key = mix(sig[:, b * rows], 7 + b)
        for j in range(1, rows):
            key = mix(key ^ sig[:, b * rows + j], 7 + b)
        keys.append(key)
    return np.stack(keys, axis=1).view(np.int64)


def least_matches(threshold: float = THRESHOLD, sketch: int = SKETCH, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches at which the posterior P(similarity >= threshold) still reaches `miss`.

    A byte matches with probability q = s + (1 - s) / 256; s has a uniform prior.
    """
    s = (np.arange(4000) + 0.5) / 4000
    q = s + (1 - s) / 256
    out = []
    for n in range(batch, sketch + 1, batch):
        for m in range(n + 1):
            w = m * np.log(q) + (n - m) * np.log1p(-q)
            w = np.exp(w - w.max())
            if w[s >= threshold].sum() >= miss * w.sum():
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, limits: list[int], batch: int = BATCH) -> np.ndarray:
    """Indexes of the pairs of sketches (rows of bytes) that no batch drops."""
    left, got = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(limits):
        cut = slice(k * batch, (k + 1) * batch)
        got = got + (a[left, cut] == b[left, cut]).sum(axis=1)
        stay = got >= least
        left, got = left[stay], got[stay]
    return left


def alike(a: np.ndarray, b: np.ndarray | None, limits: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the pairs of rows of a and of b, or (i < j) of rows of a if b is None, that no batch drops."""
    same = b is None
    b = a if same else b
    x, y = (np.ascontiguousarray(s[:, :batch].T) for s in (a, b))
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
    step = max(1, STEP_PAIRS // max(1, len(b)))
    for lo in range(0, len(a), step):
        left = lo + 1 if same else 0
        got = np.zeros((min(step, len(a) - lo), len(b) - left), dtype=np.uint8)
        for one, other in zip(x, y):  # a byte at a time: a row against all others is one operation
            got += one[lo : lo + step, None] == other[None, left:]
        i, j = np.nonzero(got >= limits[0])
        i, j = i + lo, j + left
        if same:
            i, j = i[i < j], j[i < j]
        stay = survivors(a[i], b[j], limits, batch)
        found.append((i[stay], j[stay]))
    i, j = zip(*found)
    return np.concatenate(i), np.concatenate(j)


def alike_each(sketches: np.ndarray, limits: list[int], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, i, j), i < j, of the pairs inside each of many short runs (runs x classes x bytes) that no batch drops."""
    i, j = np.triu_indices(sketches.shape[1], 1)
    got = np.zeros((len(i), len(sketches)), dtype=np.uint8)
    for column in np.ascontiguousarray(sketches[:, :, :batch].transpose(2, 1, 0)):
        got += column[i] == column[j]
    pair, run = np.nonzero(got >= limits[0])
    i, j = i[pair], j[pair]
    stay = survivors(sketches[run, i], sketches[run, j], limits, batch)
    return run[stay], i[stay], j[stay]


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def profiles(documents: DataFrame, shingle: int = SHINGLE, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, cls, keys, sketch of each record whose normal form has min_chars or more. keys and sketch are null where the
    task has just made them for the same class."""
    least = max(min_chars, shingle)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for rows in batches(rows_of(stream)):
            parts = [(k, c) for k, c in ((k, normal_form(t)) for k, t in rows) if len(c) >= least]
            if not parts:
                continue
            codes, starts, part = joined([c for _, c in parts])
            grams = rolling(codes, shingle)
            # the class: a hash of all codes in order, with the length
            place = np.arange(len(codes)) - starts[part]
            with np.errstate(over="ignore"):
                both = mix(codes.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(21)), 5)
                cls = mix(np.add.reduceat(both, starts) ^ np.diff(np.append(starts, len(codes))).astype(np.uint64), 6)
            fresh = []
            for i, c in enumerate(cls.tolist()):
                if c not in seen:
                    seen[c] = None
                    fresh.append(i)
            while len(seen) > SEEN:
                del seen[next(iter(seen))]
            keys: list = [None] * len(parts)
            sketch: list = [None] * len(parts)
            if fresh:
                ends = np.append(starts[1:], len(codes)) - shingle + 1
                sig = signatures([grams[starts[i] : ends[i]] for i in fresh])
                bands, low = band_keys(sig), (mix(sig[:, :SKETCH], 3) & np.uint64(255)).astype(np.uint8)
                for row, i in enumerate(fresh):
                    keys[i], sketch[i] = bands[row], low[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in parts], pa.int64()), pa.array(cls.view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "cls", "keys", "sketch"])

    return spread(documents.filter(F.length("text") >= least // 3).select("doc_id", "text")).mapInArrow(run, "doc_id long, cls long, keys array<long>, sketch binary")


def _runs(stream: Iterator[pa.RecordBatch], hot: int, limits: list[int]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, cls, head of the sketch) sorted by both: the pairs of each key whose heads no batch drops, or, of keys with
    more than `hot` classes, the classes."""

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), empty if b is None else pa.array(b), empty if key is None else pa.array(key)], ["a", "b", "key"])

    key, cls, head = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, HEAD), np.uint8)
    long_key = None  # a run over the limit whose classes are passed on as they come

    def work(key: np.ndarray, cls: np.ndarray, head: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
        key, cls, head = key[fresh], cls[fresh], head[fresh]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        for size in np.unique(sizes):
            if size == 1:
                continue
            at = starts[sizes == size]
            if size > hot:
                for h in at:
                    yield out(cls[h : h + size], None, key[h : h + size])
            elif size > SHORT_RUN:
                for h in at:
                    i, j = alike(head[h : h + size], None, limits)
                    yield out(cls[h + i], cls[h + j], None)
            else:
                for few in np.array_split(at, 1 + len(at) * int(size) ** 2 // (2 * STEP_PAIRS)):
                    run, i, j = alike_each(head[few[:, None] + np.arange(size)], limits)
                    yield out(cls[few[run] + i], cls[few[run] + j], None)

    for batch in stream:
        k, c, s = batch.column("key").to_numpy(), batch.column("cls").to_numpy(), _bytes(batch.column("head"), HEAD)
        if long_key is not None and len(k):
            n = int(np.searchsorted(k != long_key, True))
            if n:
                yield out(c[:n], None, k[:n])
            k, c, s = k[n:], c[n:], s[n:]
            if len(k):
                long_key = None
        key, cls, head = np.concatenate([key, k]), np.concatenate([cls, c]), np.concatenate([head, s])
        if not len(key):
            continue
        last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
        if last:
            yield from work(key[:last], cls[:last], head[:last])
            key, cls, head = key[last:], cls[last:], head[last:]
        if len(np.unique(cls)) > hot:
            yield out(cls, None, key)
            long_key, key, cls, head = int(key[0]), key[:0], cls[:0], head[:0]
    if len(key):
        yield from work(key, cls, head)


def class_links(documents: DataFrame, shingle: int = SHINGLE, min_chars: int = MIN_CHARS, threshold: float = THRESHOLD, hot: int = HOT_BUCKET, block: int = HOT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity: the linked classes, a < b; doc_id, cls: the class of each record). Both are stored."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    # shuffle files are deleted as soon as a step's table is stored, not whenever the driver collects its garbage
    quiet = apart(spark, classic_shuffleDependency_fileCleanup_enabled=True)
    made = moved(stored(profiles(documents, shingle, min_chars)), quiet)
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))
    limits = least_matches(threshold)

    def runs(first: int) -> DataFrame:
        keyed = made.filter("keys is not null").select(F.explode(F.slice("keys", first + 1, GROUP)).alias("key"), "cls", F.substring("sketch", 1, HEAD).alias("head"))
        return stored(keyed.repartition(n_tasks, "key").sortWithinPartitions("key", "cls").mapInArrow(lambda s: _runs(s, hot, limits[: HEAD // BATCH]), "a long, b long, key long"))

    groups = [runs(first) for first in range(0, BANDS, GROUP)]
    found = reduce(DataFrame.union, groups)
    classes = made.filter("sketch is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "sketch")).alias("s")).select("cls", F.col("s.doc_id").alias("doc"), F.col("s.sketch").alias("sketch"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.join(classes.select(F.col("cls").alias(x), F.col("doc").alias(f"doc_{x}"), F.col("sketch").alias(f"sketch_{x}")), x)

    pairs = found.filter("b is not null").select("a", "b").distinct()

    def prune(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                stay = survivors(_bytes(batch.column("sketch_a"), SKETCH), _bytes(batch.column("sketch_b"), SKETCH), limits)
                yield batch.select(["a", "b", "doc_a", "doc_b"]).take(pa.array(stay))

    schema = "a long, b long, doc_a long, doc_b long"
    cold = side(side(pairs, "a"), "b").select("a", "b", "doc_a", "doc_b", "sketch_a", "sketch_b").mapInArrow(prune, schema)

    # hot keys: every class goes to its block's row and column of block pairs
    hot_rows = found.filter("key is not null").select("key", F.col("a").alias("cls")).distinct()
    blocks = hot_rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")
    cells = (
        hot_rows.join(blocks, "key").withColumn("i", mine)
        .select("key", "cls", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
        .select("key", "cls", F.least("i", "o").alias("lo"), F.greatest("i", "o").alias("hi"), (F.col("i") <= F.col("o")).alias("left"), (F.col("i") == F.col("o")).alias("both"))
        .join(classes, "cls")
    )

    def cell(t: pa.Table) -> pa.Table:
        cls, doc, sk = t.column("cls").to_numpy(), t.column("doc").to_numpy(), _bytes(t.column("sketch"), SKETCH)
        left = t.column("left").to_numpy(zero_copy_only=False) if isinstance(t.column("left"), pa.Array) else np.array(t.column("left").to_pylist())
        same = bool(t.column("both")[0].as_py())
        rows, cols = (np.arange(len(cls)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        a, b = alike(sk[rows], None if same else sk[cols], limits)
        a, b = rows[a], cols[b]
        swap = cls[a] > cls[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table([pa.array(x) for x in (cls[a], cls[b], doc[a], doc[b])], names=["a", "b", "doc_a", "doc_b"])

    warm = cells.groupBy("key", "lo", "hi").applyInArrow(cell, schema)
    kept = cold.union(warm).distinct()
    texts = documents.select(F.col("doc_id").alias("d"), "text")

    def verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows: list[tuple[int, int, float]] = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                    x, y = (np.unique(rolling(normal_form(t), shingle)) for t in (x, y))
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    similarity = both / (len(x) + len(y) - both)
                    if similarity >= threshold:
                        rows.append((a, b, similarity))
            columns = list(zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    with_a = kept.join(texts.withColumnRenamed("d", "doc_a").withColumnRenamed("text", "text_a"), "doc_a").select("a", "b", "doc_b", "text_a")
    with_b = with_a.join(texts.withColumnRenamed("d", "doc_b").withColumnRenamed("text", "text_b"), "doc_b").select("a", "b", "text_a", "text_b")
    linked = stored(with_b.mapInArrow(verify, "a long, b long, similarity double").distinct())
    members = stored(made.select("doc_id", "cls"))
    drop(made, *groups)
    return moved(linked, spark), moved(members, spark)


def near_pairs(documents: DataFrame, **options) -> DataFrame:
    """doc_a < doc_b: all pairs of records whose normal forms have `min_chars` characters and a similarity of `threshold`.

    Copies are pairs too. Null and short texts have none; a doc_id that is null or paired with itself (a repeated row) is no
    pair. Other columns are ignored.
    """
    linked, members = class_links(documents, **options)
    members = members.distinct()
    m_a, m_b = members.select(F.col("doc_id").alias("x"), F.col("cls").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("cls").alias("b"))
    between = linked.join(m_a, "a").join(m_b, "b").select("x", "y")
    within = m_a.join(m_b, F.col("a") == F.col("b")).select("x", "y").filter("x < y")
    return between.union(within).filter("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def near_groups(documents: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, group_id, links of each record with a normal form of `min_chars`: class_id is the smallest doc_id with
    the same normal form, group_id the smallest doc_id linked to it directly or through others, links the number of other
    classes its class is linked to. A record without a near-copy is its own group."""
    from lexiloom.llm import linking

    linked, members = class_links(documents, **options)
    members = stored(members.distinct())
    ids = members.groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    edges = linked.join(ids.select(F.col("cls").alias("a"), F.col("class_id").alias("x")), "a").join(ids.select(F.col("cls").alias("b"), F.col("class_id").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
    edges = stored(edges)
    roots = linking.components(edges).withColumnRenamed("v", "class_id")
    degree = edges.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return (
        members.join(ids, "cls").join(roots, "class_id", "left").join(degree, "class_id", "left")
        .select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
