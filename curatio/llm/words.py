"""Words and word hashes of many UTF-8 texts at once, on numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; those bytes
never occur inside a multi-byte UTF-8 character, so splitting bytes equals
splitting code points.  Texts of a batch lie in one buffer and every step runs
over the whole buffer, so the cost does not depend on how long single texts are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed alone."""
    with np.errstate(over="ignore"):
        i = np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed) * U64(0xD1342543DE82EF95)
        return mix64(i) | U64(1)


BYTE_CODE = random_odd(256, 1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["p"]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[key] = np.cumprod(a, dtype=U64)
    return _POWERS["p"], _POWERS["q"]


class RangeHash:
    """Hash of any byte range of a buffer from prefix sums (one pass)."""

    def __init__(self, buf: np.ndarray, code: np.ndarray = BYTE_CODE):
        p, self.inv = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(code[buf] * p[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix64(h + (end - start).astype(U64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type) and not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``limit`` bytes (a longer text comes alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class WordArrays:
    """start, end: byte range of each word; first: index of each text's first word (n + 1)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, n = buf, off, len(buf)
        self.white = white = WHITE[buf]
        inside = ~white
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = white[:-1], white[1:]
        cut = off[(off > 0) & (off < n)]
        before[cut] = True
        after[cut - 1] = True
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def per_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set places of a buffer mask in each text."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def windows(first: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start index and owner of every window of ``width`` items inside one text."""
    n = np.maximum(count - width + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    base = np.cumsum(n) - n
    return np.arange(n.sum()) - base[owner] + first[:-1][owner], owner


def shingles(words: WordArrays, word_hash: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every shingle; a text with fewer words gives its whole sequence as one."""
    mult = random_odd(width, 2)
    start, owner = windows(words.first, words.count, width)
    h = np.zeros(len(start), U64)
    for k in range(width):
        h += word_hash[start + k] * mult[k]
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    hs = words.count[short].astype(U64)
    for k in range(width - 1):
        there = words.count[short] > k
        at = np.minimum(words.first[:-1][short] + k, len(word_hash) - 1)
        hs += np.where(there, word_hash[at] * mult[k], U64(0))
    if len(short):
        h, owner = np.concatenate([h, mix64(hs)]), np.concatenate([owner, short])
    return mix64(h), owner


def owner_keys(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """One integer per item that orders by owner, then hash; and how many bits the owner takes."""
    bits = max(1, int(n - 1).bit_length())
    return (owner.astype(U64) << U64(64 - bits)) | (h >> U64(bits)), bits


def distinct_per_owner(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes of each owner."""
    if not len(h):
        return np.zeros(n, np.int64)
    key, bits = owner_keys(h, owner, n)
    key = np.sort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> U64(64 - bits)).astype(np.int64), minlength=n)
