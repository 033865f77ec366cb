"""A context-mixing range coder for token ids, many blocks at a time in numpy.

A block is coded on its own: models start empty and its bytes carry a checksum.
For each id, an order-2 table (by a hash of the two ids before) and an order-1
table (by the id before) each propose an id with a confidence.  A first symbol,
adaptive for each pair of confidences, mixes them: order 2 was right, order 1 was
right, or neither.  In the last case the order-0 model codes the id in four
parts of four bits with adaptive counts.  All symbols drive one range coder
with 64-bit state and 32-bit output.

The same step of all blocks of a batch is one set of numpy operations, so the
Python cost is per step, not per id.  Coder and decoder share the model code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
BLOCK = 8192          # ids in a block
LANES = 768           # blocks coded side by side
ORDER1, ORDER2 = 1 << 12, 1 << 13
SURE = 3              # largest confidence
STEP, LIMIT = 24, 1 << 13
HALF, BOTTOM = U64(1) << U64(32), U64(1) << U64(24)
HEAD = struct.Struct("<4sIII")      # mark, ids, bytes of the payload, crc32 of ids and payload
MARK = b"CMR1"


class Counts:
    """Adaptive cumulative counts: lanes x contexts rows of ``symbols``."""

    def __init__(self, lanes: int, contexts: int, symbols: int):
        self.first = np.arange(1, symbols + 1, dtype=np.uint16)
        self.table = np.tile(self.first, (lanes * contexts, 1))
        self.contexts = contexts
        self.more = np.tril(np.full((symbols, symbols), STEP, np.uint16)).T.copy()       # row s: what symbol s adds

    def learn(self, at: np.ndarray, rows: np.ndarray, symbol: np.ndarray) -> None:
        rows += self.more[symbol]
        full = rows[:, -1] > LIMIT
        if full.any():
            rows[full] = (rows[full] >> 1) + self.first      # stays strictly rising
        self.table[at] = rows


class Coder:
    """The range coder of all lanes; ``data`` is None when coding."""

    def __init__(self, lanes: int, data: list[np.ndarray] | None = None, room: int = 0):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
        self.at = np.zeros(lanes, np.int64)
        self.decoding = data is not None
        if self.decoding:
            width = max(len(d) for d in data) + 4
            self.words = np.zeros((lanes, width), np.uint32)
            for i, d in enumerate(data):
                self.words[i, : len(d)] = d
            self.code = (self.words[:, 0].astype(U64) << U64(32)) | self.words[:, 1]
            self.at += 2
        else:
            self.words = np.zeros((lanes, room), np.uint32)

    def step(self, lane: np.ndarray | slice, rows: np.ndarray, symbol: np.ndarray | None) -> np.ndarray:
        """Code (or find) one symbol per lane under the cumulative counts ``rows``."""
        low, unit = self.low[lane], self.range[lane] // rows[:, -1]
        i = np.arange(len(rows))
        if symbol is None:
            v = np.minimum((self.code[lane] - low) // unit, rows[:, -1] - np.uint16(1)).astype(np.uint16)
            symbol = (rows <= v[:, None]).sum(axis=1)
        start = np.where(symbol > 0, rows[i, symbol - 1], np.uint16(0))
        span = (rows[i, symbol] - start) * unit
        low += start * unit
        while True:      # give out the leading 32 bits where they are settled, or where the range grows too small
            settled = (low ^ (low + span)) < HALF
            out = np.flatnonzero(settled | (span < BOTTOM))
            if not len(out):
                break
            l, sp = low[out], span[out]
            sp = np.where(settled[out], sp, (U64(0) - l) & (BOTTOM - U64(1)))
            who = out if isinstance(lane, slice) else lane[out]
            at = self.at[who]
            if self.decoding:
                self.code[who] = (self.code[who] << U64(32)) | self.words[who, np.minimum(at, self.words.shape[1] - 1)]
            else:
                self.words[who, at] = l >> U64(32)
            self.at[who] = at + 1
            low[out], span[out] = l << U64(32), sp << U64(32)
        self.low[lane], self.range[lane] = low, span
        return symbol

    def finish(self) -> list[np.ndarray]:
        """The words of each lane, with the last state."""
        for _ in range(2):
            self.words[np.arange(len(self.at)), self.at] = self.low >> U64(32)
            self.low <<= U64(32)
            self.at += 1
        return [w[:n] for w, n in zip(self.words, self.at, strict=True)]


def _run(ids: list[np.ndarray] | None, data: list[np.ndarray] | None, sizes: np.ndarray) -> list[np.ndarray]:
    """Code ``ids`` to words, or decode ``data`` to ids; lanes are sorted by falling size."""
    lanes, steps = len(sizes), int(sizes[0]) if len(sizes) else 0
    coder = Coder(lanes, data, 0 if ids is None else steps * 3 + 16)
    given = np.zeros((lanes, steps), np.uint16)
    if ids is not None:
        for i, x in enumerate(ids):
            given[i, : len(x)] = x
    choice = Counts(lanes, (SURE + 1) ** 2 * 2, 3)
    nibbles = [Counts(lanes, 1, 16), Counts(lanes, 16, 16), Counts(lanes, 256, 16), Counts(lanes, 256, 16)]
    guess1, sure1 = np.zeros((lanes, ORDER1), np.uint16), np.zeros((lanes, ORDER1), np.uint8)
    guess2, sure2 = np.zeros((lanes, ORDER2), np.uint16), np.zeros((lanes, ORDER2), np.uint8)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")        # lanes longer than the step
    for t in range(steps):
        n = int(alive[t])
        lane = np.arange(n)
        a, b = last[:n], before[:n]
        i1, i2 = (a * 40503 >> 4) & (ORDER1 - 1), ((a * 40503 + b * 30011) >> 3) & (ORDER2 - 1)
        g1, s1, g2, s2 = guess1[lane, i1], sure1[lane, i1], guess2[lane, i2], sure2[lane, i2]
        every = slice(0, n)
        at = lane * choice.contexts + ((s2.astype(np.int64) * (SURE + 1) + s1) * 2 + (g1 == g2))
        rows = choice.table[at]
        if ids is not None:
            x = given[:n, t]
            kind = np.where(x == g2, 0, np.where(x == g1, 1, 2))
            coder.step(every, rows, kind)
        else:
            kind = coder.step(every, rows, None)
            x = np.where(kind == 0, g2, g1)
        choice.learn(at, rows, kind)
        miss = np.flatnonzero(kind == 2)
        if len(miss):
            value = high = np.zeros(len(miss), np.int64)
            for part, shift in enumerate((12, 8, 4, 0)):      # the last two parts know the first two
                at = miss * nibbles[part].contexts + high
                rows = nibbles[part].table[at]
                got = coder.step(miss, rows, (x[miss].astype(np.int64) >> shift) & 15 if ids is not None else None)
                nibbles[part].learn(at, rows, got)
                value = (value << 4) | got
                if part < 2:
                    high = value
            if ids is None:
                x[miss] = value.astype(np.uint16)
        if ids is None:
            given[:n, t] = x
        for guess, sure, i, g, s in ((guess1, sure1, i1, g1, s1), (guess2, sure2, i2, g2, s2)):
            hit = g == x
            sure[lane, i] = np.where(hit, np.minimum(s + 1, SURE), s >> 1)
            guess[lane, i] = np.where(hit | (s > 0), g, x)
        before[:n] = a
        last[:n] = x
    if ids is not None:
        return coder.finish()
    return [row[:size] for row, size in zip(given, sizes, strict=True)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of an id sequence (ids under 65,536)."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be under 65,536")
    parts = [ids[i: i + block].astype("<u2") for i in range(0, len(ids), block)]
    out: list[bytes] = []
    for g in range(0, len(parts), LANES):
        some = parts[g: g + LANES]          # only the last may be shorter: sizes fall
        for x, words in zip(some, _run(some, None, np.array([len(x) for x in some])), strict=True):
            payload = words.astype("<u4").tobytes()
            out.append(HEAD.pack(MARK, len(x), len(payload), zlib.crc32(payload, zlib.crc32(x.tobytes()))) + payload)
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a damaged block raises."""
    heads = []
    for raw in blocks:
        mark, n, size, crc = HEAD.unpack_from(raw)
        if mark != MARK or len(raw) != HEAD.size + size:
            raise ValueError("not a block, or cut short")
        heads.append((n, crc))
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for g in range(0, len(order), LANES):
        some = order[g: g + LANES]
        data = [np.frombuffer(blocks[i], "<u4", offset=HEAD.size) for i in some]
        for i, ids in zip(some, _run(None, data, np.array([heads[i][0] for i in some])), strict=True):
            if zlib.crc32(blocks[i][HEAD.size:], zlib.crc32(ids.astype("<u2").tobytes())) != heads[i][1]:
                raise ValueError("checksum does not match")
            out[i] = ids
    return out
