"""Problem 4: long exact spans that stand in more than one record.

A character is shared if it lies in a stretch of SPAN characters that another record has too.

1. Passages: of all strings of PASSAGE characters inside each stretch of SPAN, the one with the smallest hash is the
   stretch's passage. Equal stretches have the same passage, so a passage recurs in two records if a stretch does. One pass
   lists each record's passages, and an aggregation confirms those that recur. Recorded sentence matches are confirmed
   passages too.
2. Shards: the passages of one record (the smallest that has them) are in one shard. A record is streamed to the shards that
   have a passage of it; no other record can contain a shared stretch with one of theirs. A shard that more than SHARD_CHARS of
   text are streamed to is dealt to several tasks, each with all of its passages.
3. A task compiles its shard's passages into an Aho-Corasick automaton and streams whole texts through it: its hits are the
   occurrences. The stretches that contain a hit are compared by rolling hashes; those of two or more records are shared.
4. What the tasks of one shard have found in one record each, an aggregation compares over all of them.
5. The shared stretches of each record are united into runs.

Whole copies are found first by a hash of the text, and only one of them is taken through 2 and 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lexiloom.llm.codes import batches, code_points, joined, mix, rolling, rows_of
from lexiloom.session import cores, drop, spread, stored

SPAN = 200
#: Characters of a passage. Longer: fewer chance recurrences; shorter: fewer passages.
PASSAGE = 80
#: Passages of a shard, on average, and characters of text that a task streams through its automaton.
SHARD_PASSAGES, SHARD_CHARS = 5000, 2_000_000
#: The passages of a record of more than so many characters go to several shards, by their place.
OWN_CHARS = 100_000
#: Copies of a text that a task remembers, to take only one further.
SEEN = 200_000


def passages(codes: np.ndarray, part: np.ndarray, span: int = SPAN, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """(part, hash, position, first stretch, last stretch) of every passage; positions in the joined codes."""
    wide = span - passage + 1
    n = len(codes) - span + 1
    none = (np.empty(0, np.int64),) * 5
    if n <= 0:
        return none
    hashes = mix(rolling(codes, passage), 11)
    # hash and place in one number: the smallest is the leftmost smallest hash
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    low = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    width, have = low, 1
    while have < wide:  # minimum over `wide` neighbours by doubling
        step = min(have, wide - have)
        width = np.minimum(width[:-step], width[step:])
        have += step
    valid = part[:n] == part[span - 1 :]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none
    at = (width[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    return part[at[head]], hashes[at[head]].view(np.int64), at[head], starts[head], starts[tail]


def _marks(documents: DataFrame, span: int, passage: int) -> DataFrame:
    """doc_id, text_hash, n_chars and the passages (null where the task has just made them for a copy) of each record."""
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())]))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for rows in batches(rows_of(stream)):
            rows = [(k, code_points(t)) for k, t in rows if t and len(t) >= span]
            if not rows:
                continue
            codes, starts, part = joined([c for _, c in rows])
            place = np.arange(len(codes)) - starts[part]
            both = mix(codes.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(21)), 21)
            sizes = np.diff(np.append(starts, len(codes)))
            with np.errstate(over="ignore"):
                text_hash = mix(np.add.reduceat(both, starts) ^ sizes.astype(np.uint64), 22).view(np.int64)
            own, hashes, pos, lo, hi = passages(codes, part, span, passage)
            fresh = np.zeros(len(rows), dtype=bool)
            for i, h in enumerate(text_hash.tolist()):
                fresh[i] = h not in seen
                seen[h] = None
            while len(seen) > SEEN:
                del seen[next(iter(seen))]
            keep = fresh[own]
            own, hashes, pos, lo, hi = (x[keep] for x in (own, hashes, pos, lo, hi))
            base = starts[own]
            items = pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), *(pa.array((x - base).astype(np.int32)) for x in (pos, lo, hi))], ["hash", "pos", "lo", "hi"])
            offsets = np.searchsorted(own, np.arange(len(rows) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~fresh, False)), items)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(text_hash), pa.array(sizes.astype(np.int32)), lists.cast(kind)], ["doc_id", "text_hash", "n_chars", "found"])

    return spread(documents.filter(F.length("text") >= span)).mapInArrow(run, "doc_id long, text_hash long, n_chars int, found array<struct<hash:long,pos:int,lo:int,hi:int>>")


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in phrases:
        if phrase:
            made.add_word(phrase, len(phrase))
    made.make_automaton()
    return made


def occurrences(made: ahocorasick.Automaton, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of all occurrences of the automaton's phrases in a text, overlapping ones too."""
    found = made.iter(text) if len(made) else ()
    hits = np.array([(end - size + 1, size) for end, size in found], dtype=np.int64).reshape(-1, 2)
    return hits[:, 0], hits[:, 1]


def candidates(made: ahocorasick.Automaton, text: str, span: int) -> np.ndarray:
    """Starts of the stretches of a text that contain an occurrence (or lie inside one that is longer)."""
    n = len(text) - span + 1
    at, size = occurrences(made, text)
    if n <= 0 or not len(at):
        return np.empty(0, np.int64)
    other = at + size - span
    low, high = np.maximum(np.minimum(at, other), 0), np.minimum(np.maximum(at, other), n - 1) + 1
    keep = low < high
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, low[keep], 1)
    np.add.at(edge, high[keep], -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class Shard:
    """The stretches of one task's texts around its automaton's hits."""

    def __init__(self, span: int):
        self.span, self.phrases, self.made = span, [], None
        self.values, self.docs, self.starts = [], [], []

    def add(self, doc: int, text: str) -> None:
        if self.made is None:
            self.made = automaton(self.phrases)
        at = candidates(self.made, text, self.span)
        if len(at):
            self.values.append(rolling(code_points(text), self.span)[at])
            self.docs.append(np.full(len(at), doc, dtype=np.int64))
            self.starts.append(at)

    def found(self, whole: bool) -> pa.RecordBatch:
        """Stretches of two records as runs; unless the task has the whole shard, also each stretch's hash with the smallest
        and largest record (start null), and the places of the stretches of one record only."""
        none = np.empty(0, np.int64)
        value, doc, start = (np.concatenate(x) if x else none for x in (self.values, self.docs, self.starts))
        order = np.argsort(value, kind="stable")
        value, doc, start = value[order].astype(np.uint64).view(np.int64), doc[order], start[order]
        head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else none
        low, high = (np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)) if len(head) else (none, none)
        two = np.repeat(low != high, np.diff(np.append(head, len(value))))
        runs = _intervals(doc[two], start[two], self.span)
        parts = [pa.RecordBatch.from_arrays([*runs.columns, *(pa.nulls(runs.num_rows, pa.int64()),) * 2], FOUND)]
        if not whole:
            empty = lambda n: pa.nulls(n, pa.int64())
            parts.append(pa.RecordBatch.from_arrays([pa.array(low), empty(len(head)), empty(len(head)), pa.array(value[head]), pa.array(high)], FOUND))
            parts.append(pa.RecordBatch.from_arrays([pa.array(doc[~two]), pa.array(start[~two]), pa.array(start[~two] + self.span), pa.array(value[~two]), empty(int((~two).sum()))], FOUND))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()


#: Rows of a shard's result: runs (value null); hashes of stretches (start null); stretches of one record.
FOUND = ["doc_id", "start_pos", "end_pos", "value", "other"]


def _stream(stream: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, parts, doc_id, body) sorted by shard, part and doc_id: passages (doc_id null) before texts."""
    now, work, whole = None, None, True
    for batch in stream:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for shard, part, parts, doc, body in zip(*(piece.column(c).to_pylist() for c in ("shard", "part", "parts", "doc_id", "body"))):
                if (shard, part) != now:
                    if work:
                        yield from work.found(whole)
                    now, work, whole = (shard, part), Shard(span), parts == 1
                if doc is None:
                    work.phrases.append(body)
                else:
                    work.add(doc, body)
    if work:
        yield from work.found(whole)


def _sent(stream: Iterator[pa.RecordBatch], passage: int) -> Iterator[pa.RecordBatch]:
    """Of each record: its text for each shard that it goes to, and the passages that are cut from it."""
    names, kinds = ["shard", "part", "parts", "doc_id", "body"], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
    rows: list[tuple] = []
    size = 0
    for batch in stream:
        for k in range(batch.num_rows):
            doc, text = batch.column("doc_id")[k].as_py(), batch.column("text")[k].as_py() or ""
            for g in batch.column("goes")[k].as_py():
                rows.append((g["shard"], g["part"], g["parts"], doc, text))
                size += len(text)
                for p in g["cut"] or ():
                    rows += [(g["shard"], part, g["parts"], None, text[p : p + passage]) for part in range(g["parts"])]
                    size += passage * g["parts"]
            if size >= 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _intervals(doc: np.ndarray, start: np.ndarray, span: int) -> pa.RecordBatch:
    """Stretches as runs of neighbours."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + span)) if len(doc) else np.empty(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc))[: len(head)] - 1
    return pa.RecordBatch.from_arrays([pa.array(doc[head], pa.int64()), pa.array(start[head], pa.int64()), pa.array(start[tail] + span, pa.int64())], ["doc_id", "start_pos", "end_pos"])


def shared_runs(documents: DataFrame, recorded: DataFrame | None = None, span: int = SPAN, passage: int = PASSAGE, shard_passages: int = SHARD_PASSAGES, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, start_pos, end_pos: every longest run of shared characters, in code points of the text as it stands.

    recorded: sentence matches (doc_id, other_id, sentence_a); sentences of `passage` characters or more are looked for in both
    records like other passages, shorter ones, null ones and unknown records are left out. Null and short texts share nothing. A
    doc_id that comes twice with one text is one record; with different texts the runs of both are united. Other columns are
    ignored.
    """
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text").filter("doc_id is not null")
    marks = stored(_marks(documents, span, passage))
    copies = marks.groupBy("text_hash").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).filter("one <> other").select("text_hash")
    whole = marks.join(copies, "text_hash", "left_semi").select("doc_id", F.lit(0).cast("long").alias("start_pos"), F.col("n_chars").cast("long").alias("end_pos"))

    # passages that recur, and the first place of each
    each = marks.filter("found is not null").select("doc_id", "n_chars", F.explode("found").alias("f")).select("doc_id", "n_chars", "f.hash", "f.pos")
    recurring = each.groupBy("hash").agg(F.min(F.struct("doc_id", "pos")).alias("own"), F.max("doc_id").alias("other")).filter("own.doc_id <> other")
    of_hash = recurring.select("hash", F.col("own.doc_id").alias("own"), F.floor(F.col("own.pos") / OWN_CHARS).alias("bucket"), F.col("own.pos").alias("own_pos"))
    first = (F.col("doc_id") == F.col("own")) & (F.col("pos") == F.col("own_pos"))
    visits = each.join(of_hash, "hash").groupBy("doc_id", "own", "bucket").agg(F.max("n_chars").alias("n_chars"), F.collect_set(F.when(first, F.col("pos"))).alias("cut"))
    if recorded is not None:
        s = recorded.select(F.col("doc_id").alias("x"), F.col("other_id").alias("y"), F.trim("sentence_a").alias("body"))
        sentences = s.filter((F.length("body") >= passage) & F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("own", F.least("x", "y")).distinct()
        there = marks.filter("found is not null").select("doc_id", "n_chars")
        told = sentences.select(F.explode(F.array("x", "y")).alias("doc_id"), "own").distinct().join(there, "doc_id")
        visits = visits.union(told.select("doc_id", "own", F.lit(0).cast("long"), "n_chars", F.array().cast("array<int>")))
    seen = Observation()
    visits = stored(visits.observe(seen, F.sum("n_chars").alias("chars"), F.sum(F.size("cut")).alias("passages")))
    # as many shards as make the text that visits each half of what a task takes, on average
    shards = max(1, -(-(seen.get["passages"] or 0) // shard_passages), -(-2 * (seen.get["chars"] or 0) // shard_chars))
    shard = F.pmod(F.xxhash64("own", "bucket"), F.lit(shards)).alias("shard")
    visits = stored(visits.groupBy("doc_id", shard).agg(F.max("n_chars").alias("n_chars"), F.flatten(F.collect_list("cut")).alias("cut")))
    parts = visits.groupBy("shard").agg(F.ceil(F.sum("n_chars") / shard_chars).cast("int").alias("parts"))
    goes = visits.join(parts, "shard").select("doc_id", F.struct("shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "parts", "cut").alias("g"))
    goes = goes.groupBy("doc_id").agg(F.collect_list("g").alias("goes"))
    kind = "shard long, part int, parts int, doc_id long, body string"
    sent = goes.join(documents, "doc_id").select("doc_id", "text", "goes").mapInArrow(lambda x: _sent(x, passage), kind)
    if recorded is not None:
        more = sentences.withColumn("bucket", F.lit(0).cast("long")).select(shard, "body").distinct().join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.lit(None).cast("long").alias("doc_id"), "body")
        sent = sent.union(more)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))
    found = sent.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "doc_id").mapInArrow(lambda x: _stream(x, span), "doc_id long, start_pos long, end_pos long, value long, other long")
    found = stored(found)
    runs = found.filter("value is null").select("doc_id", "start_pos", "end_pos")
    common = found.filter("value is not null and start_pos is null").groupBy("value").agg(F.min("doc_id").alias("one"), F.max("other").alias("two")).filter("one <> two").select("value")
    across = found.filter("value is not null and start_pos is not null").join(common, "value", "left_semi").select("doc_id", "start_pos", "end_pos")
    return _united(whole.unionByName(runs).unionByName(across))


def _united(runs: DataFrame) -> DataFrame:
    """Overlapping and touching runs of each record as one."""
    by = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.distinct().withColumn("new", F.when(before.isNull() | (F.col("start_pos") > before), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).select("doc_id", "start_pos", "end_pos")


def shared_share(documents: DataFrame, **options) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_share, runs of every record; share 0 where nothing is shared, the text is null or
    empty. A repeated row stays repeated."""
    found = shared_runs(documents, **options).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"), F.count("*").alias("runs"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return (
        documents.select("doc_id", size.alias("n_chars")).join(found, "doc_id", "left")
        .select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.when(F.col("n_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("shared_share"), F.coalesce("runs", F.lit(0)).alias("runs"))
    )
