"""Anchors and longest-previous-factor arrays on byte buffers (numpy, no Spark)."""

from __future__ import annotations

import numpy as np

from .words import U64, RangeHash, mix64

WIDTH = 50          # bytes a repeated string must have
GRAM = 20           # bytes of the anchor string inside it
SPAN = WIDTH - GRAM + 1


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive items, by doubling."""
    m, have = v, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have:]) if have < width else m


def anchors(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The anchor of every WIDTH-byte window, as runs of window starts that share one.

    A window's anchor is the leftmost GRAM-byte string in it with the least
    hash, so equal windows have equal anchors at equal distances.  Columns:
    key (the anchor string's hash), ctx (hash of all bytes of the run's windows
    and the anchor's place), text (index), start (first window start, inside
    the text) and n (number of starts)."""
    empty = {"key": np.zeros(0, U64), "ctx": np.zeros(0, U64), "text": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
    if len(buf) < WIDTH or (np.diff(off) < WIDTH).all():
        return empty
    rh = RangeHash(buf)
    p = np.arange(len(buf) - GRAM + 1)
    h = (rh.sums[GRAM:] - rh.sums[: len(p)]) * rh.inv[: len(p)]
    h = mix64(h)
    low = U64((1 << 24) - 1)
    best = sliding_min((h & ~low) | (p.astype(U64) & low), SPAN)
    n_start = np.maximum(np.diff(off) - WIDTH + 1, 0)
    text = np.repeat(np.arange(len(n_start)), n_start)
    s = np.arange(len(text)) - (np.cumsum(n_start) - n_start)[text] + off[:-1][text]
    at = s + (((best[s] & low).astype(np.int64) - s) & ((1 << 24) - 1))
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(s)))
    s0, at, text = s[i], at[i], text[i]
    return {"key": h[at], "ctx": mix64(rh(s0, s0 + n - 1 + WIDTH) + (at - s0).astype(U64) * U64(0x9E3779B97F4A7C15)),
            "text": text, "start": s0 - off[:-1][text], "n": n}


def words_of(rows: np.ndarray) -> list[np.ndarray]:
    """Byte rows (n x m) as big-endian 64-bit columns, first bytes first."""
    pad = -rows.shape[1] % 8
    if pad:
        rows = np.concatenate([rows, np.zeros((len(rows), pad), np.uint8)], axis=1)
    return list(np.ascontiguousarray(rows).view(">u8").astype(U64).T)


def common_prefix(rows: np.ndarray, order: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before it in ``order`` (0 across groups)."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        differs = rows[a] != rows[b]
        lcp = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        lcp = np.minimum(lcp, np.minimum(length[a], length[b]))
        out[1:] = np.where(group[a] == group[b], lcp, 0)
    return out


def smaller_before(match: list[int], docs: list[int]) -> list[int]:
    """Match of each place with the nearest place before it that has a smaller document.

    match[i] is the match of places i - 1 and i; the match over a stretch is the
    least inside it.  The stack keeps places of growing documents."""
    out, stack = [], []
    for least, here in zip(match, docs, strict=True):
        while stack and stack[-1][0] >= here:
            least = min(least, stack.pop()[1])
        out.append(least if stack else 0)
        stack.append((here, least))
    return out


def previous_factors(lcp: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest previous factor of every suffix, in suffix order.

    lcp[i] is the common prefix of suffixes i - 1 and i of that order.  Of all
    occurrences in smaller documents, the nearest before and the nearest after in suffix
    order match longest: the previous and the next smaller place."""
    before = smaller_before(lcp.tolist(), doc.tolist())
    after = smaller_before([0, *lcp[:0:-1].tolist()][: len(doc)], doc[::-1].tolist())[::-1]
    return np.maximum(np.array(before, np.int64), np.array(after, np.int64))


def repeated_starts(key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context index, window number) of every window that an earlier document holds.

    Context i is buf[off[i]:off[i+1]]: the bytes of n[i] windows around an
    anchor at place at[i]; only contexts of one key can share a window.  Sorted by
    what follows the anchor and by what precedes it, neighbours bound how far any
    match of a context can reach; windows within that bound are put in suffix
    order and their longest previous factors decide."""
    size = np.diff(off)
    right_len, left_len = np.minimum(size - at, WIDTH), at
    anchor = off[:-1] + at
    padded = np.concatenate([buf, np.zeros(WIDTH, np.uint8)])
    forward = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)          # a view: no place is copied
    backward = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf[::-1], np.zeros(SPAN, np.uint8)]), SPAN - 1)

    def rows(view: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        r = view[first]
        r[np.arange(r.shape[1], dtype=np.uint8)[None, :] >= length[:, None].astype(np.uint8)] = 0
        return r

    reach = []
    for view, first, length in ((forward, anchor, right_len), (backward, len(buf) - anchor, left_len)):
        r = rows(view, first, length)
        order = np.lexsort([length, *words_of(r)[::-1], key])
        lcp = common_prefix(r, order, length, key)
        best = np.zeros(len(key), np.int64)
        best[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        reach.append(best)
    right, left = reach
    # window w starts at - w bytes before the anchor
    from_, to = np.maximum(0, at - left), np.minimum(n - 1, at - (WIDTH - right))
    count = np.maximum(to - from_ + 1, 0)
    ctx = np.repeat(np.arange(len(key)), count)
    win = np.arange(len(ctx)) - (np.cumsum(count) - count)[ctx] + from_[ctx]
    if not len(ctx):
        return ctx, win
    first = off[:-1][ctx] + win
    r = forward[first]
    order = np.lexsort([doc[ctx], *words_of(r)[::-1], key[ctx]])
    lcp = common_prefix(r, order, np.full(len(ctx), WIDTH), key[ctx])
    hit = order[previous_factors(lcp, doc[ctx][order]) >= WIDTH]
    return ctx[hit], win[hit]
