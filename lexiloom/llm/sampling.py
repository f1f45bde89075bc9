"""Bounded samples of documents for training, the same for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash values are compared modulo this.
STEPS = 1 << 30


#: Blank lines, between which paragraphs stand.
BLANK_LINES = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])[^\S\r\n]*(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])\s*")


def whole_paragraphs(piece: str, first: bool, last: bool) -> str:
    """An excerpt without the cut paragraphs at its ends (the first or last one is whole where the text begins or ends); if
    nothing is left so, without the cut lines or words."""
    for border in (BLANK_LINES, re.compile(r"[\r\n]+"), re.compile(r"\s+")):
        found = list(border.finditer(piece))
        a = 0 if first else found[0].end() if found else 0
        b = len(piece) if last else found[-1].start() if found else len(piece)
        if found and piece[a:b].strip():
            return piece[a:b]
    return piece


def sample_texts(documents: DataFrame, most: int, shortest: int, longest: int) -> list[str]:
    """At most `most` texts of `shortest` characters or more: those of the smallest hashes. Of texts of over `longest` characters,
    excerpts of at most so many, at whole paragraphs anywhere in the text.

    A hash threshold keeps about 1.2 times that many of the eligible rows before anything is sorted, so that what the driver
    gets doesn't grow with the number of partitions.
    """
    size = F.length("text")
    eligible = documents.filter(size >= shortest)
    n = eligible.count()
    if not n:
        return []
    hashed = eligible.select("text", F.xxhash64("doc_id", "text").alias("h"))
    share = 1.2 * most / n
    if share < 1:
        hashed = hashed.filter(F.pmod("h", F.lit(STEPS)) < int(share * STEPS))
    # the place of an excerpt comes from the hash too
    start = F.when(size > longest, F.pmod(F.xxhash64("h"), size - longest + 1)).otherwise(0).cast("int")
    cut = hashed.select("h", size.alias("size"), start.alias("start"), F.substring("text", start + 1, F.lit(longest)).alias("text"))
    chosen = cut.orderBy(F.pmod("h", F.lit(STEPS)), "h").limit(most).collect()
    return [whole_paragraphs(r["text"], r["start"] == 0, r["start"] + longest >= r["size"]) if r["size"] > longest else r["text"] for r in chosen]
