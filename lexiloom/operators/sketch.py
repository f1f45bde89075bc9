"""Rolling-hash fingerprints, MinHash and SimHash.

The hashes are fixed arithmetic on characters. Spark's higher-order functions could fold them a character at a time, but are
interpreted; here a batch of texts is one array of characters, and a hash is a few array operations over all of its grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import blocks as B
from lexiloom.operators.pairs import checks
from lexiloom.session import cores, stored

# Base and modulus of the polynomial hash; seeds and multipliers of the 32-bit hashes; permutation modulus.
BASE, MODULUS = 101, 1_000_000_007
SEED, MIX = 0xDEADBEEF, (0xCC9E2D51, 0x1B873593, 5, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35)
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193
PRIME, LCG = 2**31 - 1, (1664525, 1013904223)
GRAM, WINDOW, PERMUTATIONS = 5, 4, 128
MASK = np.uint64(0xFFFFFFFF)


def polynomial(text: str, k: int) -> np.ndarray:
    """Hash of each k-gram of a text of a-z and 0-9."""
    c = np.frombuffer(text.encode("ascii"), dtype=np.uint8).astype(np.int64)
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.int64)
    for i in range(k):
        h = (h * BASE + c[i : i + n]) % MODULUS
    return h


def winnow(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of its gram, window) of each new minimum, in order; the leftmost of equal minima. All hashes, if there are
    fewer than a window."""
    if len(hashes) < window:
        at = np.arange(len(hashes))
        return hashes, at, at
    frames = np.lib.stride_tricks.sliding_window_view(hashes, window)
    arg = frames.argmin(axis=1)
    least = frames[np.arange(len(frames)), arg]
    _, first = np.unique(least, return_index=True)
    first.sort()
    return least[first], first + arg[first], first


def mixed32(grams: list[str]) -> np.ndarray:
    """The 32-bit mixing hash of each string (one character a block)."""
    size = np.array([len(g) for g in grams], dtype=np.int64)
    wide = int(size.max(initial=0))
    codes = np.zeros((len(grams), wide), dtype=np.uint64)
    for i, g in enumerate(grams):
        codes[i, : len(g)] = np.frombuffer(g.encode("utf-32-le"), dtype=np.uint32)
    u = np.uint64
    h = np.full(len(grams), SEED, dtype=np.uint64)
    a, b, five, add, f1, f2 = map(u, MIX)
    for i in range(wide):
        live = size > i
        k = codes[live, i] * a & MASK
        k = (k << u(15) | k >> u(17)) & MASK
        x = h[live] ^ (k * b & MASK)
        x = (x << u(13) | x >> u(19)) & MASK
        h[live] = (x * five + add) & MASK
    h ^= size.astype(np.uint64)
    h = (h ^ (h >> u(16))) * f1 & MASK
    h = (h ^ (h >> u(13))) * f2 & MASK
    return h ^ (h >> u(16))


def fnv32(words: list[str]) -> np.ndarray:
    size = np.array([len(w) for w in words], dtype=np.int64)
    h = np.full(len(words), FNV_OFFSET, dtype=np.uint64)
    codes = np.zeros((len(words), int(size.max(initial=0))), dtype=np.uint64)
    for i, w in enumerate(words):
        codes[i, : len(w)] = np.frombuffer(w.encode("ascii"), dtype=np.uint8)
    for i in range(codes.shape[1]):
        live = size > i
        h[live] = (h[live] ^ codes[live, i]) * np.uint64(FNV_PRIME) & MASK
    return h


@lru_cache(maxsize=4)
def permutations(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients by a linear congruential generator, in turn."""
    seed, a, b = SEED, [], []
    for _ in range(n):
        seed = (seed * LCG[0] + LCG[1]) % 2**32
        a.append(seed % PRIME + 1)
        seed = (seed * LCG[0] + LCG[1]) % 2**32
        b.append(seed % PRIME)
    return np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)


def minhash(grams: list[str], n: int = PERMUTATIONS) -> np.ndarray:
    """Per permutation the least (a x + b) mod p, in double arithmetic (as published: the product is rounded); zeros for none."""
    return minhashes(mixed32(grams), np.array([0, len(grams)]), n)[0].astype(np.float64)


def minhashes(x: np.ndarray, ends: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """minhash of each of the texts whose gram hashes lie one behind the other in x, a row each. The rounded products are
    whole numbers below 2^63: their remainder by p = 2^31 - 1 is found by adding their halves, many times as fast as by fmod."""
    a, b = (c[:, None] for c in permutations(n))
    out = np.full((len(ends) - 1, n), PRIME, dtype=np.int64)
    x = x.astype(np.float64)
    for at in range(0, len(x), 512):
        part = a * x[at : at + 512]
        part += b
        v = part.astype(np.int64)
        for _ in range(2):
            v = (v & PRIME) + (v >> 31)
        v = np.minimum(v.view(np.uint64), (v - PRIME).view(np.uint64)).view(np.int64)  # below 0 it wraps
        first = int(np.searchsorted(ends, at, "right")) - 1
        rows = first + np.flatnonzero(np.diff(np.clip(ends[first : int(np.searchsorted(ends, at + v.shape[1])) + 1], at, at + v.shape[1])))
        out[rows] = np.minimum(out[rows], np.minimum.reduceat(v, np.maximum(ends[rows] - at, 0), axis=1).T)
    out[np.diff(ends) == 0] = 0
    return out


def mixed32_of(strings: pa.Array) -> np.ndarray:
    """mixed32 of an Arrow array of strings of a-z, 0-9 and blanks."""
    strings = strings.cast(pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, longest = offsets[:-1][order], size[order]
    u = np.uint64
    h = np.full(len(strings), SEED, dtype=np.uint64)
    a, b, five, add, f1, f2 = map(u, MIX)
    for i in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-longest, -i))  # those longer than i
        k = data[start[:live] + i].astype(np.uint64) * a & MASK
        k = (k << u(15) | k >> u(17)) & MASK
        x = h[:live] ^ (k * b & MASK)
        x = (x << u(13) | x >> u(19)) & MASK
        h[:live] = (x * five + add) & MASK
    h ^= longest.astype(np.uint64)
    h = (h ^ (h >> u(16))) * f1 & MASK
    h = (h ^ (h >> u(13))) * f2 & MASK
    out = np.empty_like(h)
    out[order] = h ^ (h >> u(16))
    return out


def simhash(words: list[str]) -> int:
    if not words:
        return 0
    unique: dict[str, int] = {}
    for w in words:
        unique[w] = unique.get(w, 0) + 1
    h, n = fnv32(list(unique)), np.array(list(unique.values()), dtype=np.int64)
    bits = (h[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1)
    votes = ((2 * bits.astype(np.int64) - 1) * n[:, None]).sum(axis=0)
    return int(sum(1 << i for i in range(32) if votes[i] > 0))


def _mapped(df: DataFrame, keep: list[str], source: str, out: str, kind: str, fn) -> DataFrame:
    """keep and out = fn(source), row by row in Arrow batches."""
    arrow = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<struct<hash:bigint,gram:string,position:int>>": pa.list_(pa.struct([("hash", pa.int64()), ("gram", pa.string()), ("position", pa.int32())]))}[kind]
    rows = df.select(*keep, F.col(source).alias("src"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "src") + f", `{out}` {kind}"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([fn(x) for x in part.column("src").to_pylist()], arrow)], [*keep, out])

    return rows.mapInArrow(run, schema)


def gram_hashes(df: DataFrame, keep: list[str], c: str, out: str, k: int = GRAM) -> DataFrame:
    return _mapped(df.withColumn("_f", T.fingerprint_text(c)), keep, "_f", out, "array<bigint>", lambda t: polynomial(t, k).tolist())


def fingerprints(df: DataFrame, keep: list[str], c: str, out: str, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """keep and the winnowed (hash, gram, position) of the text in c."""

    def one(t: str) -> list[dict]:
        h, at, pos = winnow(polynomial(t, k), window)
        return [{"hash": int(x), "gram": t[i : i + k], "position": int(p)} for x, i, p in zip(h, at, pos)]

    return _mapped(df.withColumn("_f", T.fingerprint_text(c)), keep, "_f", out, "array<struct<hash:bigint,gram:string,position:int>>", one)


def rabin(documents: DataFrame) -> DataFrame:
    """doc_id, grams, first_hash, sum_hash, distinct_hashes of the 5-gram hash stream of each document."""
    h = F.col("h")
    return gram_hashes(documents, ["doc_id"], "text", "h").select("doc_id", F.size(h).cast("long").alias("grams"), F.get(h, 0).alias("first_hash"), F.aggregate(h, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("sum_hash"), F.size(F.array_distinct(h)).cast("long").alias("distinct_hashes"))


def winnowed(documents: DataFrame) -> DataFrame:
    """doc_id, position, hash, gram: the fingerprint of each document; none for a text without letters or digits."""
    return fingerprints(documents, ["doc_id"], "text", "f").select("doc_id", F.explode("f").alias("f")).select("doc_id", F.col("f.position").cast("long").alias("position"), "f.hash", "f.gram")


def fingerprint_compare(single_checks: DataFrame, limit: int = 30) -> DataFrame:
    """check_id, jaccard, a_in_b, b_in_a, size_a, size_b, grams: comparison of the fingerprints of both texts."""
    both = fingerprints(fingerprints(checks(single_checks), ["check_id", "b"], "a", "fa"), ["check_id", "fa"], "b", "fb")
    ha, hb = F.array_distinct(F.col("fa.hash")), F.array_distinct(F.col("fb.hash"))
    rows = both.select("check_id", "fa", ha.alias("ha"), hb.alias("hb"))
    inter, na, nb = F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb")
    grams = F.slice(F.array_distinct(F.transform(F.filter("fa", lambda f: F.array_contains(F.col("hb"), f["hash"])), lambda f: f["gram"])), 1, limit)
    return rows.select("check_id", T.rounded(T.ratio(inter, na + nb - inter), 4).alias("jaccard"), T.rounded(T.ratio(inter, na), 4).alias("a_in_b"), T.rounded(T.ratio(inter, nb), 4).alias("b_in_a"), na.cast("long").alias("size_a"), nb.cast("long").alias("size_b"), F.array_join(grams, " ").alias("grams"))


def copied_blocks(single_checks: DataFrame, length: int = 8) -> DataFrame:
    """check_id, n, blocks: distinct strings of `length` of the submission that the reference has, in order."""
    ga, gb = T.char_grams(T.fingerprint_text("a"), length), T.char_grams(T.fingerprint_text("b"), length)
    rows = checks(single_checks).select("check_id", F.array_intersect(ga, gb).alias("x"))
    return rows.select("check_id", F.size("x").cast("long").alias("n"), F.array_join("x", " ").alias("blocks"))


def simhashes(documents: DataFrame) -> DataFrame:
    """doc_id, simhash (0 to 2^32 - 1) of each document; 0 without a word of more than two letters."""
    words = F.filter(T.tokens_all("text"), lambda t: F.length(t) > 2)
    return _mapped(documents.withColumn("_w", words), ["doc_id"], "_w", "simhash", "bigint", simhash)


def simhash_compare(single_checks: DataFrame) -> DataFrame:
    """check_id, simhash_a, simhash_b, hamming, similarity, near, pct."""
    words = lambda c: F.filter(T.tokens_all(c), lambda t: F.length(t) > 2)
    pairs = checks(single_checks).select("check_id", words("a").alias("a"), words("b").alias("b"))
    both = _mapped(_mapped(pairs, ["check_id", "b"], "a", "simhash_a", "bigint", simhash), ["check_id", "simhash_a"], "b", "simhash_b", "bigint", simhash)
    d = F.bit_count(F.col("simhash_a").bitwiseXOR(F.col("simhash_b"))).cast("long")
    s = F.greatest(F.lit(0.0), 1 - d / 32)
    return both.select("check_id", "simhash_a", "simhash_b", d.alias("hamming"), T.rounded(s, 4).alias("similarity"), (d <= 4).alias("near"), T.percent(s).alias("pct"))


def near_paragraphs(single_checks: DataFrame, threshold: float = 0.80) -> DataFrame:
    """check_id, index_a, index_b, similarity of the paragraphs (over 30 characters) of both texts whose SimHash similarity
    reaches the threshold. At a distance of d bits, one of any d + 1 bands of the 32 bits is equal: paragraphs meet by
    equal bands, which loses none."""
    pairs = checks(single_checks)
    distance = int((1 - threshold) * 32 + 1e-9)
    edges = [32 * k // (distance + 1) for k in range(distance + 2)]
    bands = [(k, a, (1 << (b - a)) - 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))]

    def side(c: str, index: str, out: str) -> DataFrame:
        parts = F.filter(F.split(c, "\n{2,}|\r\n{2,}"), lambda p: F.length(T.trimmed(p)) > 30)
        units = pairs.select("check_id", F.posexplode(parts).alias(index, "p")).withColumn("w", F.filter(T.tokens_all("p"), lambda t: F.length(t) > 2))
        hashed = _mapped(units, ["check_id", index], "w", out, "bigint", simhash)
        cells = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftright(out, a).bitwiseAND(F.lit(mask)).alias("bits")) for k, a, mask in bands])
        return hashed.select("check_id", index, out, F.explode(cells).alias("c")).select("check_id", index, out, "c.band", "c.bits")

    both = side("a", "index_a", "ha").join(side("b", "index_b", "hb"), ["check_id", "band", "bits"]).select("check_id", "index_a", "index_b", "ha", "hb").distinct()
    s = 1 - F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))) / 32
    return both.withColumn("s", s).filter(F.col("s") >= threshold).select("check_id", F.col("index_a").cast("long").alias("index_a"), F.col("index_b").cast("long").alias("index_b"), T.rounded(F.col("s"), 4).alias("similarity"))


def _signed(df: DataFrame, keep: list[str], tokens: Column, k: int, out: str, kind: str, made) -> DataFrame:
    """keep and out = made(the min-hashes of many rows, a row each)."""
    rows = df.select(*keep, F.array_distinct(T.word_grams(tokens, k)).alias("_g"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_g") + f", `{out}` {kind}"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                grams = part.column("_g")
                ends = np.append(0, np.cumsum(grams.value_lengths().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made(minhashes(mixed32_of(grams.flatten()), ends))], [*keep, out])

    return rows.mapInArrow(run, schema)


def minhash_signatures(df: DataFrame, keep: list[str], tokens: Column, out: str, k: int = 2) -> DataFrame:
    return _signed(df, keep, tokens, k, out, "array<double>", lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * PERMUTATIONS), pa.array(v.astype(np.float64).ravel())))


def minhash_values(documents: DataFrame) -> DataFrame:
    """doc_id, permutation, value of the 128 min-hashes over word bigrams; zeros without any."""
    return minhash_signatures(documents, ["doc_id"], T.tokens_all("text"), "sig").select("doc_id", F.posexplode("sig").alias("permutation", "value")).select("doc_id", F.col("permutation").cast("long").alias("permutation"), "value")


def estimate(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / PERMUTATIONS


def minhash_compare(single_checks: DataFrame) -> DataFrame:
    """check_id, bigram, trigram, score, pct: .55 of the bigram and .45 of the trigram estimate."""
    pairs = checks(single_checks)
    rows = pairs
    keep = ["check_id", "a", "b"]
    for c in ("a", "b"):
        for k in (2, 3):
            rows = minhash_signatures(rows, keep, T.tokens_all(c), f"{c}{k}", k)
            keep = [*keep, f"{c}{k}"]
    rows = rows.select("check_id", estimate(F.col("a2"), F.col("b2")).alias("x"), estimate(F.col("a3"), F.col("b3")).alias("y"))
    score = F.col("x") * 0.55 + F.col("y") * 0.45
    return rows.select("check_id", T.rounded(F.col("x"), 4).alias("bigram"), T.rounded(F.col("y"), 4).alias("trigram"), T.rounded(score, 4).alias("score"), T.percent(T.rounded(score, 9)).alias("pct"))


def minhash_matrix(documents: DataFrame, every: int = 20) -> DataFrame:
    """doc_id, links, best_id, best_sim of each document whose id is divisible by `every`: with how many others it shares a
    min-hash, and the most similar one (ties: smallest id); no row without one. Of a doc_id that comes twice the smallest
    text counts.

    Documents of one signature are a class, so that copies meet once and not each with each. Equal values of two classes are
    counted by blocks (see blocks), and no pair is stored.
    """
    documents = documents.filter("doc_id is not null")
    count = B.parts(documents, documents.count())
    one = documents.groupBy("doc_id").agg(F.min(T.text_of("text")).alias("text"))
    sig = _signed(one, ["doc_id"], T.tokens_all("text"), 2, "sig", "binary", lambda v: pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary()))
    classes = sig.repartition(count, "sig").groupBy("sig").agg(F.collect_list("doc_id").alias("ids"))
    blocks = stored(classes.mapInArrow(lambda stream: B.signature_blocks(stream, every), "d array<binary>, q array<binary>"))
    queries = max(1, -(-2 * cores(documents.sparkSession) // count), -(-count // 64))
    sims = B.met(blocks, B.open_signatures, B.nearest_by_signature, "doc_id long, links long, n long, best long", queries)
    rows = sims.groupBy("doc_id").agg(F.sum("links").alias("links"), F.min(F.struct((-F.col("n")).alias("n"), "best")).alias("m"))
    return rows.select("doc_id", "links", F.col("m.best").alias("best_id"), T.rounded(-F.col("m.n") / PERMUTATIONS, 4).alias("best_sim"))
