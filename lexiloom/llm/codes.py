"""Texts as arrays of code points: normal form, rolling hashes, batches of bounded size."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Characters handled at once by the array code; bounds a Python worker's memory. A longer text is a batch of its own.
BATCH_CHARS = 1_000_000


@lru_cache(maxsize=1)
def _kept() -> np.ndarray:
    """Whether a code point is a letter or number (general categories L and N)."""
    table = np.zeros(0x110000, dtype=bool)
    for start, stop in ((0, 0xD800), (0xE000, 0x110000)):
        table[start:stop] = [unicodedata.category(chr(c))[0] in "LN" for c in range(start, stop)]
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normal_form(text: str | None) -> np.ndarray:
    """Lower-cased code points without anything that is not a letter or number; empty for null."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    c = code_points(text.lower())
    return c[_kept()[c]]


_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal inputs only give equal outputs."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, k: int, base: int = int(_P)) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every k consecutive codes, by doubling; len(codes) - k + 1 values."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = mix(codes.astype(np.uint64))  # hash of length 1 at each position
        width, out, done = 1, None, 0
        power = base | 1
        while True:
            if k & width:
                if out is None:
                    out, done = h, width
                else:  # h covers the first `width` codes, out the `done` codes after them
                    m = min(len(h), len(out) - width)
                    out = h[:m] * np.uint64(pow(base | 1, done, 1 << 64)) + out[width : width + m]
                    done += width
            if done == k:
                return out[:n]
            h = h[:-width] * np.uint64(power) + h[width:]
            power = power * power % (1 << 64)
            width *= 2


def batches(rows: Iterable[tuple[int, str | None]], limit: int = BATCH_CHARS) -> Iterator[list[tuple[int, str | None]]]:
    """Rows in lists of about `limit` characters together."""
    part: list[tuple[int, str | None]] = []
    size = 0
    for key, text in rows:
        part.append((key, text))
        size += len(text or "") + 50
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def rows_of(stream: Iterable, key: str = "doc_id", text: str = "text") -> Iterator[tuple[int, str | None]]:
    """(key, text) of Arrow record batches; texts become Python strings a slice at a time."""
    for batch in stream:
        keys, texts = batch.column(key), batch.column(text)
        for at in range(0, batch.num_rows, 256):
            yield from zip(keys.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist())


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenation, the start of each part and the part of each element."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(parts) else np.empty(0, dtype=np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), starts, np.repeat(np.arange(len(parts)), lengths)
