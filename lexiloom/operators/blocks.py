"""Scores of query documents with all documents, by blocks of postings: nothing is stored or exchanged per pair.

Documents are packed into blocks, arrays of numbers that one task can hold. Every block of documents meets every block of
queries once, in a cartesian product that reads the stored blocks; a task adds up the scores of a query with all documents of the
block in one array, and what leaves it is one row for each query and block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.functions import lexicon
from lexiloom.session import apart, cores, drop, moved, stored, stored_table

#: Documents and numbers after which a block is closed; blocks are planned smaller than MOST, so that a part rarely makes two.
#: Of tokens half as many, as their grams are three times as many.
PLANNED, MOST, NUMBERS = 24_000, 32_768, 6_000_000
LEAST, STEP = 2_000, 512

#: Of the scores of pairs: the IDF of a term that one of the two has, BM25, the grams' shares; a multiplier of hashes.
IDF, K1, LENGTH, SHARES = math.log(1.5) + 1, 1.5, 0.75, {2: 0.18, 3: 0.17, 4: 0.10}
LEAST_K, MOST_K = K1 * (1 - LENGTH), K1 * (1 + LENGTH)
MIX = np.uint64(0x9E3779B97F4A7C15)


def parts(df: DataFrame, rows: int, planned: int = PLANNED) -> int:
    """Partitions for packing so many rows: a block each, and enough of them for all cores unless they would be small."""
    return max(1, -(-rows // planned), min(2 * cores(df.sparkSession), -(-rows // LEAST)))


def whole_ids(stream: Iterator[pa.RecordBatch], key: str = "doc_id") -> Iterator[pa.Table]:
    """The rows of a stream that is sorted by a key, in small tables that have all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    for batch in stream:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            ids = part.column(key).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(ids, ids[-1]))
            if held and held[-1].column(key)[0].as_py() != ids[-1] and not last:
                yield pa.Table.from_batches(held)
                held = []
            if last:  # what is before the last key is whole
                yield pa.Table.from_batches([*held, part.slice(0, last)])
                held = []
            held.append(part.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def gathered(tables: Iterator[pa.Table], column: str, numbers: int = NUMBERS) -> Iterator[pa.Table]:
    """Small tables put together for one block each, by rows and by the numbers in a column of lists."""
    held: list[pa.Table] = []
    rows = size = 0
    for part in tables:
        held.append(part)
        rows, size = rows + part.num_rows, size + sum(len(c.flatten()) for c in part.column(column).chunks)
        if rows > MOST - STEP or size > numbers:
            yield pa.concat_tables(held)
            held, rows, size = [], 0, 0
    if held:
        yield pa.concat_tables(held)


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values) of a column of lists."""
    lengths = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.empty(0, np.int64)
    return np.repeat(np.arange(len(column)), lengths), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, and the end."""
    if not len(ordered):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])


def packed(*arrays: np.ndarray) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def unpacked(raw: list[bytes], kinds: str) -> list[np.ndarray]:
    """Arrays of packed(), by their type letters."""
    return [np.frombuffer(x, dtype=k) for x, k in zip(raw, kinds, strict=True)]


def found(have: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted ones, -1 if it isn't there."""
    if not len(have):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    return np.where(have[at] == wanted, at, -1)


def met(blocks: DataFrame, open_block: Callable, score: Callable, schema: str, queries: int = 0) -> DataFrame:
    """The rows that score(open_block(d), q) yields for every block of documents d and of queries q (columns of stored
    blocks, which are deleted), stored. queries: partitions of the blocks of queries, if not those of their files; a block of
    documents is opened once for each."""
    spark = blocks.sparkSession
    own = apart(spark, execution_arrow_maxRecordsPerBatch=1, classic_shuffleDependency_fileCleanup_enabled=True)
    there = moved(blocks, own)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, block = None, None
        for batch in stream:
            for d, q in zip(batch.column("d"), batch.column("q"), strict=True):
                if raw is None or not d.equals(raw):
                    raw, block = d, open_block(d.as_py())
                rows = score(block, q.as_py())
                if rows is not None and len(rows[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)

    asked = there.filter("q is not null").select("q")
    both = there.select("d").hint("shuffle_replicate_nl").crossJoin(asked.coalesce(queries) if queries else asked)
    out = stored(both.mapInArrow(run, schema))
    drop(blocks)
    return stored_table(spark, out._stored_at, out.schema)


# Corpus TF-IDF cosine: documents are vectors of (term, count), terms are 64-bit hashes.


def term_counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, terms, counts of rows (doc_id, h) sorted by doc_id; n is the size of a document's first row, counts are of all."""
    for table in whole_ids(stream):
        ids = table.column("doc_id").to_numpy()
        first = heads(ids)
        at, h = lists(table.column("h"))
        n = np.bincount(at, minlength=len(ids))[first[:-1]]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        begin = np.concatenate([[0], np.flatnonzero((doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) + 1])
        counts = np.diff(np.append(begin, len(h)))
        offsets = pa.array(np.searchsorted(doc[begin], np.arange(len(first))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first[:-1]]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(h[begin])), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32)))], ["doc_id", "n", "terms", "counts"])


def weighted_blocks(stream: Iterator[pa.RecordBatch], known: np.ndarray, idf: np.ndarray, alone: float, every: int) -> Iterator[pa.RecordBatch]:
    """Blocks d (ids in order, sizes, norms, terms, their idf, beginnings, documents, counts) and q (ids, norms, beginnings,
    terms, weights) of rows (doc_id, n, terms, counts); terms are places among the known ones."""
    for table in gathered((pa.Table.from_batches([b.slice(at, STEP)]) for b in stream for at in range(0, b.num_rows, STEP)), "terms"):
        table = table.sort_by("doc_id")
        ids, n = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
        (doc, h), (_, counts) = lists(table.column("terms")), lists(table.column("counts"))
        term = found(known, h)
        seen = term >= 0
        weight = counts / n[doc] * np.where(seen, np.append(idf, alone)[term], alone)
        norms = np.sqrt(np.bincount(doc, weight * weight, minlength=len(ids)))
        doc, term, counts, weight = doc[seen], term[seen], counts[seen], weight[seen]
        mine = ids[doc] % every == 0
        asked = np.flatnonzero(ids % every == 0)
        q = packed(ids[asked], norms[asked], np.searchsorted(doc[mine], np.append(asked, len(ids))), term[mine].astype(np.int32), weight[mine]) if len(asked) else None
        order = np.argsort(term, kind="stable")
        doc, term, counts = doc[order], term[order], counts[order]
        begin = heads(term)
        d = packed(ids, n.astype(np.int32), norms, term[begin[:-1]].astype(np.int32), idf[term[begin[:-1]]], begin, doc.astype(np.uint16), counts.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.list_(pa.binary())), pa.array([q], pa.list_(pa.binary()))], ["d", "q"])


def open_weighted(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    ids, n, norms, terms, idf, begin, docs, counts = unpacked(raw, "qidid" + "qHi")
    docs = docs.astype(np.int64)
    return ids, norms, terms, begin, docs, counts / n[docs] * np.repeat(idf, np.diff(begin))


def nearest_by_weight(block: tuple[np.ndarray, ...], raw: list[bytes]) -> list[np.ndarray]:
    """q, how many documents of the block have a cosine above 0, the largest and the first document that has it."""
    ids, norms, terms, begin, docs, weights = block
    asked, own, at, wanted, own_weights = unpacked(raw, "qdqid")
    place = found(terms, wanted)
    there = place >= 0
    at = np.concatenate([[0], np.cumsum(there)])[at]
    place, own_weights = place[there], own_weights[there]
    start, end, self = begin[place], begin[place + 1], found(ids, asked)
    rows = []
    for k, q in enumerate(asked.tolist()):
        some = slice(at[k], at[k + 1])
        ranges = list(zip(start[some].tolist(), end[some].tolist()))
        if not ranges:
            continue
        w = np.concatenate([weights[x:y] for x, y in ranges])
        w *= np.repeat(own_weights[some], end[some] - start[some])
        sim = np.bincount(np.concatenate([docs[x:y] for x, y in ranges]), w, len(ids))
        sim /= norms * own[k]
        np.minimum(sim, 1.0, out=sim)
        sim *= 1e4
        sim += 0.5
        np.floor(sim, out=sim)
        if self[k] >= 0:
            sim[self[k]] = 0
        best = int(sim.argmax())
        if sim[best] > 0:
            rows.append((q, np.count_nonzero(sim), sim[best] / 1e4, ids[best]))
    q, links, sims, best = zip(*rows) if rows else ([], [], [], [])
    return [np.array(q, np.int64), np.array(links, np.int64), np.array(sims, np.float64), np.array(best, np.int64)]


# Similarity of pairs: cosine and BM25 of the two documents alone, and the shares of a query's 2-, 3- and 4-grams.


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def _runs(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all runs of n tokens; the keys of different n differ."""
    same = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.empty(0, np.int64)
    key = np.full(len(same), n, dtype=np.uint64)
    for k in range(n):
        key = key * MIX ^ h[same + k]
        key ^= key >> np.uint64(29)
    return row[same], key


def _grams(h: np.ndarray, row: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, n) of the distinct content 2-grams and 3-grams and 4-grams of each row, by key, then row."""
    hc, rc = h[content], row[content]
    each = [_runs(hc, rc, 2), _runs(hc, rc, 3), _runs(h, row, 4)]
    n = np.repeat(np.array([2, 3, 4], np.uint8), [len(r) for r, _ in each])
    row, key = np.concatenate([r for r, _ in each]), np.concatenate([k for _, k in each])
    order = np.argsort(key, kind="stable")
    row, key, n = row[order], key[order], n[order]
    kept = np.ones(len(key), dtype=bool)
    kept[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[kept], key[kept], n[kept]


def _terms(word: np.ndarray, doc: np.ndarray, documents: int) -> tuple[np.ndarray, ...]:
    """word, doc, tf by word, then doc; per document its tokens, distinct ones and sum of squared relative frequencies."""
    order = np.lexsort((doc, word))
    word, doc = word[order], doc[order]
    begin = np.concatenate([[0], np.flatnonzero((word[1:] != word[:-1]) | (doc[1:] != doc[:-1])) + 1]) if len(word) else np.empty(0, np.int64)
    tf = np.diff(np.append(begin, len(word))).astype(np.float64)
    word, doc = word[begin], doc[begin]
    n = np.bincount(doc, tf, documents)
    with np.errstate(invalid="ignore"):
        return word, doc, tf, n, np.bincount(doc, minlength=documents).astype(np.float64), np.bincount(doc, tf * tf, documents) / (n * n)


def token_blocks(stream: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Blocks d (ids in order, document of each row, beginnings of rows, words, hashes and content flags of the vocabulary in
    the order of the hashes) and q (ids, n, u, sq; beginnings, hashes and tf of their terms; beginnings, keys and weights of
    their grams) of rows (doc_id, t) sorted by doc_id."""
    for table in gathered(whole_ids(stream), "t", NUMBERS // 2):
        all_ids = table.column("doc_id").to_numpy()
        first = heads(all_ids)
        ids, doc_of = all_ids[first[:-1]], np.repeat(np.arange(len(first) - 1), np.diff(first))
        tokens = table.column("t").combine_chunks()
        size = tokens.value_lengths().to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        hashes = np.array([_hash(w) for w in vocabulary], dtype=np.int64)
        content = np.array([len(w) > 2 and w not in lexicon.STOP_WORDS for w in vocabulary], dtype=bool)
        order = np.argsort(hashes)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        word, hashes, content = place[coded.indices.to_numpy()], hashes[order], content[order]
        d = packed(ids, doc_of.astype(np.int32), np.append(0, np.cumsum(size)), word.astype(np.uint32), hashes, content)
        asked = np.flatnonzero(ids % every == 0)
        q = None
        if len(asked):
            row = np.repeat(np.arange(len(size)), size)
            mine = ids[doc_of[row]] % every == 0
            row, word = row[mine], word[mine]
            at, key, n = _grams(hashes[word].astype(np.uint64), row, content[word])
            weights = np.zeros(len(key))
            for k, share in SHARES.items():
                of = np.bincount(at[n == k], minlength=len(size))
                rows = np.flatnonzero(of)[::-1]
                sizes = np.zeros(len(ids))
                sizes[doc_of[rows]] = of[rows]  # of a repeated document its first row's
                weights[n == k] = share / sizes[doc_of[at[n == k]]]
            order = np.argsort(doc_of[at], kind="stable")
            g, key, weights = doc_of[at][order], key[order], weights[order]
            w, doc, tf, n, u, sq = _terms(word[content[word]], doc_of[row[content[word]]], len(ids))
            order = np.argsort(doc, kind="stable")
            ends = np.append(asked, len(ids))
            q = packed(ids[asked], n[asked], u[asked], sq[asked], np.searchsorted(doc[order], ends), hashes[w[order]], tf[order], np.searchsorted(g, ends), key, weights)
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.list_(pa.binary())), pa.array([q], pa.list_(pa.binary()))], ["d", "q"])


def _bm25(tf: np.ndarray, n: np.ndarray | float) -> np.ndarray:
    """What a term adds to a BM25 sum, times tf + K."""
    return np.log(1 + 1 / (tf / n + 0.001)) * (tf * (K1 + 1))


def open_tokens(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Postings of terms lead to slots, one for each document and tf that it has, sorted by document; what a shared term adds
    depends on nothing else of the document."""
    ids, doc_of, ends, word, hashes, content = unpacked(raw, "qiqIq?")
    row = np.repeat(np.arange(len(doc_of)), np.diff(ends))
    at, key, _ = _grams(hashes[word].astype(np.uint64), row, content[word])
    gram_begin = heads(key)
    kept = content[word]
    w, doc, tf, n, u, sq = _terms(word[kept].astype(np.int64), doc_of[row[kept]], len(ids))
    begin, wide = heads(w), int(tf.max(initial=0)) + 1
    slot, slots = np.unique(doc.astype(np.int64) * wide + tf.astype(np.int64), return_inverse=True)
    slot_begin = np.searchsorted(slot, np.arange(len(ids) + 1) * wide)
    tf, of = (slot % wide).astype(np.float64), slot // wide
    tops, largest, steepest = _bm25(tf, n[of]), np.zeros(len(ids)), np.zeros(len(ids))
    np.maximum.at(largest, of, tops * (1 + MOST_K) / (tf + MOST_K))  # by 1 + K at least what a term adds: the quotient falls with K
    np.maximum.at(steepest, of, (tf / n[of]) ** 2 / sq[of])
    return ids, n, u, sq, hashes[w[begin[:-1]]], begin, slots, slot_begin, tf, tf / n[of], tops, largest, steepest, key[gram_begin[:-1]], gram_begin, doc_of[at].astype(np.int64)


def _joined(values: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    return np.concatenate([values[x:y] for x, y in ranges])


def _places(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of many short ranges."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def nearest_by_similarity(block: tuple[np.ndarray, ...], raw: list[bytes], least_pct: int) -> list[np.ndarray]:
    """q, o, pct of the pairs over least_pct. Shared terms are counted by slot; the number of them and the grams bound a
    similarity from above, and it is worked out from the slots of the documents whose bound reaches the limit."""
    ids, n, u, sq, terms, begin, slots, slot_begin, tf, rates, tops, largest, steepest, keys, gram_begin, gram_docs = block
    asked, qn, qu, qsq, own_at, own_terms, own_tf, gram_at, gram_keys, gram_weights = unpacked(raw, "qdddqqdqQd")
    place, gram_place = found(terms, own_terms), found(keys, gram_keys)
    there, gram_there = place >= 0, gram_place >= 0
    at, gram_at = (np.concatenate([[0], np.cumsum(x)])[y] for x, y in ((there, own_at), (gram_there, gram_at)))
    place, qtf, gram_place, gram_weights = place[there], own_tf[there], gram_place[gram_there], gram_weights[gram_there]
    start, end, gram_start, gram_end = begin[place], begin[place + 1], gram_begin[gram_place], gram_begin[gram_place + 1]
    self, upto, edges = found(ids, asked), np.zeros(len(tf) + 1, dtype=np.int64), np.empty(len(ids) + 1, dtype=np.int64)
    limit, c2 = (least_pct + 0.5) / 100 - 1e-6, IDF * IDF
    thirds = 1 / (3 * np.maximum(u, 1))
    part = lambda share: np.sqrt(share / (c2 - (c2 - 1) * share))
    out = []
    for k, na in enumerate(qn.tolist()):
        some = slice(at[k], at[k + 1])
        values = np.unique(qtf[some])
        if not len(values):
            continue
        first, last, by = start[some], end[some], qtf[some]
        total = np.bincount(_joined(slots, list(zip(first.tolist(), last.tolist()))), minlength=len(tf))
        upto[1:] = np.cumsum(total)
        upto.take(slot_begin, out=edges)
        shared = np.diff(edges)
        if self[k] >= 0:
            shared[self[k]] = 0
        rest = slice(gram_at[k], gram_at[k + 1])
        x, y = gram_start[rest], gram_end[rest]
        grams = np.bincount(gram_docs[_places(x, y)], np.repeat(gram_weights[rest], y - x), len(ids))
        own = own_tf[own_at[k] : own_at[k + 1]]
        squares, sums = (np.append(0.0, np.cumsum(np.sort(x)[::-1])) for x in ((own / na) ** 2, _bm25(own, na) * (1 + MOST_K) / (own + MOST_K)))
        cosines = part(np.minimum(squares / qsq[k], 1)) * 0.3
        # first with the other side's part of the cosine at its most, and K at its least
        most = np.minimum((sums * (1 / (1 + LEAST_K)))[shared] * thirds, 1) * 0.125
        most += cosines[shared]
        most += shared * largest * (0.125 / ((1 + LEAST_K) * 3 * qu[k]))
        most += grams
        mine = np.flatnonzero((most >= limit) & (shared > 0))
        nb, count = n[mine], shared[mine]
        ka, kb = (K1 * (1 - LENGTH + LENGTH * (x / ((na + nb) / 2))) for x in (na, nb))
        most = cosines[count] * part(np.minimum(count * steepest[mine], 1))
        most += np.minimum(sums[count] * thirds[mine] / (1 + ka), 1) * 0.125
        most += np.minimum(count * largest[mine] / ((1 + kb) * (3 * qu[k])), 1) * 0.125
        most += grams[mine]
        kept = np.flatnonzero(most >= limit)
        if not len(kept):
            continue
        mine, nb, ka, kb = mine[kept], nb[kept], ka[kept], kb[kept]
        size = slot_begin[mine + 1] - slot_begin[mine]
        cut, pos = np.cumsum(size) - size, _places(slot_begin[mine], slot_begin[mine + 1])
        number, rate = total[pos], rates[pos]
        more = [np.bincount(_joined(slots, list(zip(first[by == v].tolist(), last[by == v].tolist()))), minlength=len(tf))[pos] for v in values[1:]]
        counts = [number - sum(more), *more]
        by_value = [np.add.reduceat(c, cut) for c in counts]
        sa, sb = sum((v / na) ** 2 * c for v, c in zip(values, by_value)), np.add.reduceat(number * rate * rate, cut)
        cosine = np.add.reduceat(sum(v / na * c for v, c in zip(values, counts)) * rate, cut) / (np.sqrt(c2 * qsq[k] - (c2 - 1) * sa) * np.sqrt(c2 * sq[mine] - (c2 - 1) * sb))
        ab = np.add.reduceat(number * tops[pos] / (tf[pos] + np.repeat(kb, size)), cut) / (qu[k] * 3)
        ba = sum(t / (v + ka) * c for v, t, c in zip(values, _bm25(values, na), by_value)) / (u[mine] * 3)
        combined = np.minimum(np.minimum(cosine, 1) * 0.30 + (np.minimum(ab, 1) + np.minimum(ba, 1)) / 2 * 0.25 + grams[mine], 1)
        pct = np.floor(np.floor(combined * 1e9 + 0.5) / 1e9 * 100 + 0.5).astype(np.int64)
        kept = np.flatnonzero(pct > least_pct)
        out.append((np.full(len(kept), asked[k]), ids[mine[kept]], pct[kept]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def nearest_links(block: tuple[np.ndarray, ...], raw: list[bytes], least_pct: int) -> list[np.ndarray]:
    """q, how many documents of the block are over least_pct, the largest and the first document that has it."""
    q, o, pct = nearest_by_similarity(block, raw, least_pct)
    order = np.lexsort((o, -pct, q))
    begin = heads(q[order])
    best = order[begin[:-1]]
    return [q[best], np.diff(begin), pct[best], o[best]]


# Min-hashes: classes of documents of one signature.


def signature_blocks(stream: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """Blocks d (first ids of the classes in order, sizes, signatures) and q (first and second ids, sizes, signatures of the classes
    that have a query; beginnings of their queries, queries) of rows (sig, ids)."""
    for table in gathered((pa.Table.from_batches([b.slice(at, STEP)]) for b in stream for at in range(0, b.num_rows, STEP)), "ids"):
        at, ids = lists(table.column("ids"))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        begin = heads(at)
        size = np.diff(begin)
        second = np.where(size > 1, np.append(ids, 0)[begin[:-1] + 1], -1)
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.int32).reshape(len(size), -1)
        order = np.argsort(ids[begin[:-1]])
        place = np.argsort(order)
        first, size, second, sigs = ids[begin[:-1]][order], size[order], second[order], sigs[order]
        mine = ids % every == 0
        asked, at = ids[mine], place[at[mine]]
        by = np.argsort(at, kind="stable")
        asked, at = asked[by], at[by]
        q, some = None, heads(at)
        if len(asked):
            have = at[some[:-1]]
            q = packed(first[have], second[have], size[have], sigs[have], some, asked)
        yield pa.RecordBatch.from_arrays([pa.array([packed(first, size, sigs)], pa.list_(pa.binary())), pa.array([q], pa.list_(pa.binary()))], ["d", "q"])


def _cells(sigs: np.ndarray, rows: int) -> np.ndarray:
    """(permutation, value) of each value of the signatures, as one number."""
    sigs = sigs.reshape(rows, -1)
    return (np.arange(sigs.shape[1]) << 32) + sigs


def open_signatures(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    first, size, sigs = unpacked(raw, "qqi")
    cells = _cells(sigs, len(first))
    order = np.argsort(cells, axis=0, kind="stable")  # the permutations are in order already
    cells = np.take_along_axis(cells, order, axis=0).T.ravel()
    begin = heads(cells)
    return first, size, cells[begin[:-1]], begin, order.T.ravel()


def nearest_by_signature(block: tuple[np.ndarray, ...], raw: list[bytes]) -> list[np.ndarray]:
    """query, how many documents of the block have an equal min-hash, the most equal ones and the first document that has them."""
    first, size, cells, begin, classes = block
    firsts, seconds, sizes, sigs, at, asked = unpacked(raw, "qqqiqq")
    wanted = _cells(sigs, len(firsts))
    place = found(cells, wanted.ravel()).reshape(wanted.shape)
    self = found(first, firsts)
    several = np.flatnonzero(size > 1)
    more = size[several] - 1
    rows = []
    for k in range(len(firsts)):
        there = place[k][place[k] >= 0]
        equal = np.zeros(1, dtype=np.int64)
        if len(there):
            equal = np.bincount(np.concatenate([classes[x:y] for x, y in zip(begin[there].tolist(), begin[there + 1].tolist())]), minlength=len(first))
        if self[k] >= 0:
            equal[self[k]] = 0
        best = int(equal.argmax())
        links, most, nearest = 0, int(equal[best]), int(first[best])
        if most:
            links = int(np.count_nonzero(equal)) + int(more[equal[several] > 0].sum())
        copies = int(sizes[k]) - 1 if self[k] >= 0 else 0
        for q in asked[at[k] : at[k + 1]].tolist():
            if copies:
                rows.append((q, links + copies, wanted.shape[1], int(seconds[k] if q == firsts[k] else firsts[k])))
            elif links:
                rows.append((q, links, most, nearest))
    return [np.array(x, np.int64) for x in zip(*rows)] if rows else [np.empty(0, np.int64)] * 4
