"""Quality rules: gradient-boosted trees over document statistics (operator 3).

One Arrow pass turns each whole text into a fixed row of statistics.  A boosted
ensemble is fitted on a bounded sample of labelled rows and flattened into
complete-binary-tree node arrays, so scoring is a handful of numpy gathers per
tree level for all rows at once.  Chosen features carry monotonic constraints: more duplicate
lines, repeated words or symbols can never raise a score.

Defined cases: a null or empty text has no words and fails the base rule; null
ids and repeated rows are scored row by row like any other; without labelled
rows of both classes no model is fitted and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .words import RangeHash, WordArrays, buffers, chunks, distinct_per_owner, owner_keys, per_text, random_odd, windows

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_lines", "n_upper", "n_digits", "n_stops", "n_single", "n_distinct", "n_symbol_words"]
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "words_per_line",
            "upper_share", "digit_share", "stop_share", "single_share", "distinct_share", "symbol_word_share"]
#: +1: the score never falls as the feature grows, -1: it never rises.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "symbol_word_share": -1}

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The BASE and MORE counts of every text of an Arrow array."""
    buf, off = buffers(texts)
    n = len(off) - 1
    w = WordArrays(buf, off)
    range_hash = RangeHash(buf)
    word_hash = range_hash(w.start, w.end)
    char = (buf & 0xC0) != 0x80
    symbol = SYMBOL[buf]
    owner = w.owner()

    # lines: every text has one more than it has newlines
    breaks = np.flatnonzero(buf == 10)
    n_breaks = np.diff(np.searchsorted(breaks, off))
    line_owner = np.repeat(np.arange(n), n_breaks + 1)
    last = np.cumsum(n_breaks + 1) - 1
    line_end = np.empty(len(line_owner), np.int64)
    inner = np.ones(len(line_owner), bool)
    inner[last] = False
    line_end[inner], line_end[last] = breaks, off[1:]
    line_start = np.empty_like(line_end)
    line_start[1:] = line_end[:-1] + 1
    first = np.concatenate([[0], last[:-1] + 1]) if n else last
    line_start[first] = off[:-1]
    worded = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    ls, le, lo = line_start[worded], line_end[worded], line_owner[worded]
    n_lines = np.bincount(lo, minlength=n)

    # words inside three-word windows that occur twice or more
    at, own = windows(w.first, w.count, 3)
    mult = random_odd(3, 5)
    h = word_hash[at] * mult[0] + word_hash[at + 1] * mult[1] + word_hash[at + 2] * mult[2] if len(at) else word_hash[:0]
    repeat = np.zeros(len(owner) + 3, np.int64)
    if len(at):
        key, _ = owner_keys(h ^ (h >> np.uint64(29)), own, n)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeat, at[twice], 1)
        np.add.at(repeat, at[twice] + 3, -1)
    covered = np.cumsum(repeat)[: len(owner)] > 0
    symbol_before = np.concatenate([[0], np.cumsum(symbol)])
    word_symbol = symbol_before[w.end] > symbol_before[w.start]
    return {
        "n_words": w.count, "word_chars": per_text(char & ~w.white, off), "n_symbols": per_text(symbol, off),
        "n_dup_lines": n_lines - distinct_per_owner(range_hash(ls, le), lo, n),
        "n_repeat_words": np.bincount(owner[covered], minlength=n),
        "n_chars": per_text(char, off), "n_lines": n_lines, "n_upper": per_text(UPPER[buf], off),
        "n_digits": per_text(DIGIT[buf], off), "n_stops": per_text(STOP[buf], off),
        "n_single": np.bincount(owner[(w.end - w.start) == 1], minlength=n),
        "n_distinct": distinct_per_owner(word_hash, owner, n),
        "n_symbol_words": np.bincount(owner[word_symbol], minlength=n),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """The FEATURES matrix of counted texts."""
    f = {k: np.asarray(v, float) for k, v in s.items()}
    words, chars, lines = np.maximum(f["n_words"], 1), np.maximum(f["n_chars"], 1), np.maximum(f["n_lines"], 1)
    return np.stack([np.log1p(f["n_words"]), f["word_chars"] / words, f["n_symbols"] / chars, f["n_dup_lines"] / lines,
                     f["n_repeat_words"] / words, f["n_words"] / lines, f["n_upper"] / chars, f["n_digits"] / chars,
                     f["n_stops"] / words, f["n_single"] / words, f["n_distinct"] / words,
                     f["n_symbol_words"] / words], axis=1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the BASE and MORE counts of every row."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                s = text_statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64())] + [pa.array(s[k].astype(np.int64)) for k in BASE + MORE],
                                                 names=["doc_id", *BASE, *MORE])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(
        count, "doc_id long, " + ", ".join(f"{k} long" for k in BASE + MORE))


@dataclass
class Trees:
    """Boosted trees as node arrays: row t holds tree t, node i has children 2i+1 and 2i+2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row of a feature matrix."""
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Histogram gradient boosting on the logistic loss with monotonic constraints.

    A split on a constrained feature is taken only if the child values keep its
    direction; the midpoint then bounds all values below, so the constraint
    holds for the whole tree."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])   # code <= c  <=>  x <= edge[c]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    nodes, leaf0 = 2 ** (depth + 1) - 1, 2 ** depth - 1
    out = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes)), depth, bias)
    margin = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        for level in range(depth):
            lo, m = 2 ** level - 1, 2 ** level
            best = np.zeros(m)
            where = np.zeros((m, 2), np.int64) - 1
            values = np.zeros((m, 2))
            for j in range(k):
                width = len(edges[j]) + 1
                if width < 2:
                    continue
                slot = (node - lo) * width + code[j]
                G = np.cumsum(np.bincount(slot, g, m * width).reshape(m, width), axis=1)
                H = np.cumsum(np.bincount(slot, h, m * width).reshape(m, width), axis=1)
                gl, hl = G[:, :-1], H[:, :-1]
                gr, hr = G[:, -1:] - gl, H[:, -1:] - hl
                a, b = low[lo: lo + m, None], high[lo: lo + m, None]
                vl, vr = np.clip(gl / (hl + l2), a, b), np.clip(gr / (hr + l2), a, b)
                v0 = np.clip(G[:, -1:] / (H[:, -1:] + l2), a, b)
                gain = (gl * vl - (hl + l2) * vl * vl / 2) + (gr * vr - (hr + l2) * vr * vr / 2) \
                    - (G[:, -1:] * v0 - (H[:, -1:] + l2) * v0 * v0 / 2)
                gain[(hl < least) | (hr < least) | (monotone[j] * (vr - vl) < 0)] = 0
                c = gain.argmax(axis=1)
                i = np.arange(m)
                better = gain[i, c] > best + 1e-12
                best[better] = gain[i, c][better]
                where[better] = np.stack([np.full(m, j), c], axis=1)[better]
                values[better] = np.stack([vl[i, c], vr[i, c]], axis=1)[better]
            for i in range(m):
                at = lo + i
                left, right = 2 * at + 1, 2 * at + 2
                low[left] = low[right] = low[at]
                high[left] = high[right] = high[at]
                if where[i, 0] < 0:
                    continue          # threshold stays infinite: every row goes left
                j, c = where[i]
                out.feature[t, at], out.threshold[t, at] = j, edges[j][c]
                middle = values[i].mean()
                if monotone[j] > 0:
                    high[left], low[right] = middle, middle
                elif monotone[j] < 0:
                    low[left], high[right] = middle, middle
            f, thr = out.feature[t][node], out.threshold[t][node]
            node = 2 * node + 1 + (x[np.arange(n), f] > thr)
        leaf = node - leaf0
        G, H = np.bincount(leaf, g, 2 ** depth), np.bincount(leaf, h, 2 ** depth)
        out.value[t, leaf0:] = rate * np.clip(G / (H + l2), low[leaf0:], high[leaf0:])
        margin += out.value[t][node]
    return out


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
                max_train_rows: int = 20_000, **params) -> Trees | None:
    """Fit on at most ``max_train_rows`` labelled rows, the smallest by a hash of the id
    (so the sample does not depend on partitions); None without both classes."""
    known = pick(labels, doc_id=id_col, label=label_col).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *BASE).limit(max_train_rows)
    got = rows.select("label", *BASE, *MORE).toPandas()
    if got["label"].nunique() < 2:
        return None
    x = features({k: got[k].to_numpy() for k in BASE + MORE})
    return fit_trees(x, got["label"].to_numpy(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]), **params)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", threshold: float = 0.5, max_train_rows: int = 20_000,
                  carry: bool = False) -> DataFrame:
    """doc_id, the base counts, base_failed, score (probability of good quality) and kept.

    base_failed: fewer than 50 words, or over half of the words lie in repeated
    three-word windows.  kept is false for those, else score >= threshold.
    With ``carry`` the rows hold all columns of ``docs`` and kept alone (the
    statistics are then counted in a second pass beside the texts)."""
    stats = materialize(document_statistics(docs, id_col, text_col))
    model = fit_quality(stats, labels, id_col, label_col, max_train_rows)

    def judge(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        score = 1 / (1 + np.exp(-model.score(features(s)))) if model is not None else np.ones(len(failed))
        return failed, score, ~failed & (score >= threshold)

    if carry:
        where = docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, text_col):
                    kept = judge(text_statistics(part.column(where)))[2]
                    yield part.filter(pa.array(kept))

        return docs.mapInArrow(keep, docs.schema)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy() for k in BASE + MORE}
            failed, score, kept = judge(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [batch.column(k) for k in BASE]
                                             + [pa.array(failed), pa.array(score), pa.array(kept)],
                                             names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return stats.mapInArrow(verdicts, "doc_id long, " + ", ".join(f"{k} long" for k in BASE)
                            + ", base_failed boolean, score double, kept boolean")
