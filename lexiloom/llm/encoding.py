"""Problem 7: token ids of every text, by a monoid tree reduction over halves of a text.

The value of a stretch of text is (ids, ends of its pre-tokens), both as if the stretch stood alone. Two neighbours are
joined by splitting a window around their border again. The regular expression that makes pre-tokens never looks back, so
from any common pre-token end on, the right neighbour's pre-tokens are those of the joined text; and every pre-token that
ends three or more characters before the border (no alternative looks further ahead) is one of the joined text as well.
The window grows until it has such an end on either side; all ids outside are kept as they are.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lexiloom.session import default_tokenizers, spread

#: The published pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that the pattern can look ahead of a pre-token's start beyond its end.
AHEAD = 3
#: Texts up to this many characters are one leaf of the tree.
LEAF_CHARS = 4096


@dataclass
class Node:
    start: int
    end: int
    ids: np.ndarray
    cuts: np.ndarray  # ends of pre-tokens, ascending; the last is `end`


class TreeEncoder:
    """Encodes with the ranks of a .tiktoken file; `leaf` is the longest stretch that is encoded at once."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.leaf = max(leaf, 2)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.width = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.coder.encode_ordinary(text)
        return self._tree(text, 0, len(text)).ids.tolist()

    def decode(self, ids: list[int]) -> str:
        """Concatenation of the tokens' bytes: the tree's inverse needs no joins."""
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8")

    def _tree(self, text: str, start: int, end: int) -> Node:
        if end - start <= self.leaf:
            return self._node(text, start, end)
        middle = (start + end) // 2
        return self._join(text, self._tree(text, start, middle), self._tree(text, middle, end))

    def _node(self, text: str, start: int, end: int) -> Node:
        part = text[start:end]
        cuts = np.array([start + m.end() for m in self.pattern.finditer(part)], dtype=np.int64)
        return Node(start, end, np.array(self.coder.encode_ordinary(part), dtype=np.int32), cuts)

    def _tokens_over(self, ids: np.ndarray, n_bytes: int, last: bool) -> int | None:
        """How many first (or last) ids have n_bytes bytes together; None if no token ends there."""
        sums = np.cumsum(self.width[ids[::-1] if last else ids])
        at = int(np.searchsorted(sums, n_bytes)) if n_bytes else -1
        return at + 1 if at < 0 or at < len(sums) and sums[at] == n_bytes else None

    def _join(self, text: str, left: Node, right: Node) -> Node:
        k = int(np.searchsorted(left.cuts, left.end - AHEAD, side="right"))
        begin = int(left.cuts[k - 1]) if k else left.start
        width = 64
        while True:
            stop = min(right.start + width, right.end)
            ends = [begin + m.end() for m in self.pattern.finditer(text[begin:stop])]
            sure = np.array([e for e in ends if right.start <= e <= stop - AHEAD or e == right.end], dtype=np.int64)
            common = sure[(sure == right.start) | np.isin(sure, right.cuts)]
            if len(common):
                meet = int(common[0])
                break
            if stop == right.end:
                meet = right.end
                break
            width *= 4
        drop = self._tokens_over(left.ids, len(text[begin : left.end].encode()), last=True)
        skip = self._tokens_over(right.ids, len(text[right.start : meet].encode()), last=False)
        if drop is None or skip is None:  # the two pattern engines know another version of Unicode
            return self._node(text, left.start, right.end)
        ends = [e for e in ends if e <= meet]
        middle: list[int] = []
        for a, b in zip([begin, *ends], ends):
            middle += self.coder.encode_ordinary(text[a:b])
        ids = np.concatenate([left.ids[: len(left.ids) - drop], np.array(middle, dtype=np.int32), right.ids[skip:]])
        cuts = np.concatenate([left.cuts[:k], np.array(ends, dtype=np.int64), right.cuts[right.cuts > meet]])
        return Node(left.start, right.end, ids, cuts)


@lru_cache(maxsize=2)
def encoder(path: str, leaf: int = LEAF_CHARS) -> TreeEncoder:
    """One encoder per Python worker."""
    return TreeEncoder(path, leaf)


def vocabulary(folder: str | None = None) -> str:
    return os.path.join(folder or default_tokenizers(), "byte_bpe_50k.tiktoken")


def token_ids(documents: DataFrame, folder: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids: the ids of each text, without special tokens. Null and empty texts give an empty list.

    Row-local: no exchange of texts. Strings that look like special tokens are ordinary text. Repeated rows stay repeated;
    other columns are ignored.
    """
    path = vocabulary(folder)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, leaf)
        for batch in stream:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [code.encode(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, folder: str | None = None, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, tokens: how many ids token_ids() has for each text; the ids themselves stay in the Python worker."""
    path = vocabulary(folder)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, leaf)
        for batch in stream:
            n = [len(code.encode(t)) for at in range(0, batch.num_rows, 512) for t in batch.column("text").slice(at, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, tokens long")
