"""Problem 8: items into containers of fixed capacity by sum-of-squares packing.

An item goes where the sum over residual gaps g of (open containers with gap g)^2 becomes smallest. Groups of items, drawn
by a hash of their id, are packed independently of each other: a group's size is a parameter, so no task grows with the
corpus, and what a group leaves open at its end is small against what it fills.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import cores, stored

#: Items packed together, on average.
GROUP_ITEMS = 5000
#: Most container kinds; they are a parameter table, sent to every task.
MAX_LIMITS = 1000


class SquaresPacker:
    """Online sum-of-squares packing of sizes 1..capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.squares = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap, 1..capacity-1
        self.open: dict[int, list[int]] = {}
        self.containers = 0

    def put(self, size: int) -> int:
        """The container that `size` goes into. Ties take the smallest gap, a new container last."""
        cap, n = self.capacity, self.squares
        # change of the sum: the gap that is used loses one, the gap that is left (if any) gains one
        left = 2 * n[0 : cap - size + 1] + 1
        left[0] = 0
        change = left - (2 * n[size:] - 1)
        usable = n[size:] > 0
        best = None
        if usable.any():
            gaps = np.flatnonzero(usable)
            at = int(gaps[np.argmin(change[gaps])])
            best = (int(change[at]), at + size)
        fresh = int(left[cap - size]) if size < cap else 0
        if best is None or fresh < best[0]:
            where, gap = self.containers, cap
            self.containers += 1
        else:
            gap = best[1]
            where = self.open[gap].pop()
            n[gap] -= 1
        rest = gap - size
        if rest:
            self.open.setdefault(rest, []).append(where)
            n[rest] += 1
        return where


def pack(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[list, int]:
    """Rows (id, piece, start, end, container) and the number of containers. Only items above the capacity are split, into
    full containers and a rest. Items go in by falling size, then id."""
    packer, rows, full, rests = SquaresPacker(capacity), [], 0, []
    for i, n in zip(ids.tolist(), sizes.tolist()):
        whole = (n - 1) // capacity if n > capacity else 0
        for piece in range(whole):
            rows.append((i, piece, piece * capacity, (piece + 1) * capacity, full))
            full += 1
        rests.append((whole * capacity - n, i, whole, whole * capacity, n))
    for _, i, piece, start, end in sorted(rests):
        rows.append((i, piece, start, end, full + packer.put(end - start)))
    return rows, full + packer.containers


def packed(counts: DataFrame, limits: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """limit_name, container, doc_id, piece, start_token, end_token: each document of `counts` (doc_id, tokens) packed into
    containers of each row of `limits` (limit_name, capacity).

    A document with no tokens has one row per limit with a null container. Rows with a null name or a capacity below 1 are
    no limits; a limit that is named twice is used once, with its smallest capacity. A doc_id that occurs more than once is
    one item (its largest count). Containers are numbered apart in each group of items: the name is group-number.
    """
    spark = counts.sparkSession
    kinds = limits.filter("limit_name is not null and capacity >= 1").groupBy("limit_name").agg(F.min("capacity").alias("capacity")).limit(MAX_LIMITS + 1).collect()
    if len(kinds) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} container kinds")
    kinds = sorted((r["limit_name"], int(r["capacity"])) for r in kinds)
    items = stored(counts.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    groups = max(1, -(-items.count() // group_items))
    schema = "limit_name string, container string, doc_id long, piece int, start_token long, end_token long"

    def run(group: pa.Table) -> pa.Table:
        ids, sizes = group.column("doc_id").to_numpy(), group.column("tokens").to_numpy()
        at, some = group.column("g")[0].as_py(), sizes > 0
        out: list[tuple] = []
        for name, capacity in kinds:
            rows, _ = pack(ids[some], sizes[some], capacity)
            out += [(name, f"{at}-{c}", i, p, a, b) for i, p, a, b, c in rows]
            out += [(name, None, i, 0, 0, 0) for i in ids[~some].tolist()]
        kinds_of = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        columns = list(zip(*out)) if out else [[] for _ in kinds_of]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds_of)], names=["limit_name", "container", "doc_id", "piece", "start_token", "end_token"])

    grouped = items.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return grouped.repartition(min(groups, 4 * cores(spark)), "g").groupBy("g").applyInArrow(run, schema)


def fill(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """limit_name, containers, tokens, unused_share of a packing."""
    caps = limits.filter("limit_name is not null and capacity >= 1").groupBy("limit_name").agg(F.min("capacity").alias("capacity"))
    used = (
        rows.filter("container is not null")
        .groupBy("limit_name", "container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("t"))
        .groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    )
    return used.join(caps, "limit_name").select("limit_name", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))
