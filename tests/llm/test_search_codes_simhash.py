"""Lexical search, vector codes and SimHash against brute force."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

import brute
import edge

SF = "/root/testdata/sf0.001"


def texts():
    import duckdb
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# lexical search ------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search_by_hand(docs, items, k=20):
    counted = [(i, collections.Counter(TERM.findall(lower(t)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        terms = collections.Counter(TERM.findall(lower(text)))
        scores = []
        for i, c, n in counted:
            m = 75 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in terms.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "one TWO four, two: xä 漢字 and jo"), (2, None), (3, ""), (4, "nothingofthekind"), (5, "é É é word-word_word1"), (6, "one TWO four, two: xä 漢字 and jo"), (7, "!?")]


def frame_of_items(spark, items):
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.selectExpr("*", "'x' AS row", "'y' AS id", "'z' AS size", "'w' AS score")


@pytest.mark.parametrize("limit,cells,k", [(1 << 24, 1 << 21, 20), (60, 5, 2)])
def test_search_matches_brute_force(spark, limit, cells, k, monkeypatch):
    from curatio.llm import search
    monkeypatch.setattr(search, "INDEX_BYTES", limit)
    monkeypatch.setattr(search, "CELLS", cells)
    data = edge.rows() + [(1000 + i, t) for i, t in texts()]
    items = ITEMS + [(10, data[0][1]), (11, "the same line"), (12, edge.passage(3, 30_000))]
    got = search.search(edge.with_clashes(edge.frame(spark, data)).drop("id"), frame_of_items(spark, items), k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == search_by_hand(data, items, k)


def test_search_of_empty_tables(spark):
    from curatio.llm.search import search
    items = frame_of_items(spark, ITEMS)
    assert search(edge.frame(spark, []), items).collect() == []
    assert search(edge.frame(spark, [(1, None), (2, "..."), (None, "one")]), items).collect() == []
    assert search(edge.frame(spark), items.where("false")).collect() == []
    assert search(edge.frame(spark), items.where("item_id = 2")).collect() == []


def test_index_tells_terms_of_equal_hash_apart(monkeypatch):
    """With a hash that keeps a few values only, each look-up is settled by the bytes."""
    import pyarrow as pa

    from curatio.llm import search

    class Coarse(search.RangeHash):
        def __call__(self, start, end):
            return super().__call__(start, end) % np.uint64(4096)

    monkeypatch.setattr(search, "RangeHash", Coarse)
    index = search.ItemIndex(["alpha beta gamma beta", "beta"])
    docs = [" ".join(f"w{i}" for i in range(20_000)), "Beta alpha BETA"]
    n, doc, term, tf = index.counts(pa.array(docs))
    assert n.tolist() == [20_000, 3] and doc.tolist() == [1, 1] and sorted(tf.tolist()) == [1, 2]


# vector codes --------------------------------------------------------------------

def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    """(id, label, code, error) in Python integers, and the codebooks."""
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(4096 * x) for x in v]))
    if not kept:
        return [], [[] for _ in range(parts)]
    length = -(-max(len(v) for _, _, v in kept) // parts) * parts
    kept = [(i, label, v + [0] * (length - len(v))) for i, label, v in kept]
    w = length // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[v[p * w:(p + 1) * w] for _, _, v in order[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, _, v in kept:
                groups[near(p, v[p * w:(p + 1) * w])[1]].append(v[p * w:(p + 1) * w])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, label, v in kept:
        best = [near(p, v[p * w:(p + 1) * w]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return df.selectExpr("*", "'a' AS id", "'b' AS v", "'c' AS code", "0 AS error", "'d' AS place")


def some_vectors(n, dim, seed=1):
    r = np.random.RandomState(seed)
    return [(int(i), [float(np.float32(x)) for x in r.randn(dim) * (1 + i % 3)], [None, 0, 1, 2][i % 4]) for i in r.permutation(n)]


@pytest.mark.parametrize("rows", [
    some_vectors(200, 24) + [(500, None, 1), (501, [], 1), (502, [1.0, None] * 12, 1), (503, [float("nan")] * 24, 1), (504, [float("inf")] + [0.0] * 23, 0),
                             (None, [0.5] * 24, None), (7, [-0.25] * 24, 2), (7, [-0.25] * 24, 2), (600, [1.0, 2.0], None)],
    some_vectors(5, 13), some_vectors(40, 8), [(i, [1.0] * 16, None) for i in range(50)], [(1, [-1e-9] * 8, 3)]])
def test_codes_match_brute_force(spark, rows, monkeypatch):
    from curatio.llm import codes
    monkeypatch.setattr(codes, "ROWS", 7)
    coded, books = codes.vector_codes(vectors(spark, rows))
    want, want_books = codes_by_hand(rows)
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(want, key=repr)
    assert books.tolist() == want_books
    sums = collections.Counter()
    for _, label, _, error in want:
        sums[label] += error
    got = codes.with_label_errors(coded).collect()
    assert len(got) == len(want) and all(r.label_error == sums[r.label] for r in got)


def test_codes_of_no_vectors_and_of_too_large_ones(spark):
    from curatio.llm import codes
    coded, books = codes.vector_codes(vectors(spark, [(1, None, 1), (2, [], None)]))
    assert codes.with_label_errors(coded).collect() == [] and codes.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    assert codes.vector_codes(vectors(spark, []))[0].collect() == []
    with pytest.raises(ValueError, match="too large"):
        codes.vector_codes(vectors(spark, [(1, [1e20] * 8, 1)]))


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transform_keeps_distances_and_orders_by_sign_changes(size):
    from curatio.llm.codes import sequency_order, walsh
    rows = walsh(np.eye(size, dtype=np.int64)).T
    assert ((rows[:, 1:] != rows[:, :-1]).sum(1) == np.arange(size)).all() and sorted(sequency_order(size)) == list(range(size))
    x = np.random.RandomState(0).randint(-99, 99, (20, max(1, size - 1)))
    d = walsh(x)[:, None] - walsh(x)[None]
    assert ((d * d).sum(2) == walsh(x).shape[1] * ((x[:, None] - x[None]) ** 2).sum(2)).all()


def test_ties_go_to_the_lowest_entry():
    from curatio.llm.codes import nearest, walsh
    e = np.array([[9, 9, 9], [1, 0, 0], [-1, 0, 0], [1, 0, 0]])
    code, d = nearest(walsh(np.array([[0, 0, 0], [1, 0, 0], [5, 5, 4]])), walsh(e))
    assert code.tolist() == [1, 1, 0] and d.tolist() == [4, 0, 4 * 57]


# SimHash -------------------------------------------------------------------------

def fingerprint_by_hand(text):
    w = brute.WORD.findall(lower(text))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(fps):
    fps = np.array(sorted(set(fps)), np.uint64)
    label = np.arange(len(fps))
    near = [np.flatnonzero(np.bitwise_count(fps ^ f) <= 3) for f in fps]
    while True:
        new = np.array([label[n].min() for n in near], int)
        if (new == label).all():
            return dict(zip(fps.tolist(), label.tolist(), strict=True))
        label = new


def test_simhash_matches_brute_force(spark):
    from curatio.llm.simhash import near_duplicates
    data = edge.rows() + [(1000 + i, t) for i, t in texts()]
    fp = [fingerprint_by_hand(t) for _, t in data]
    label = classes_by_hand(fp)
    low = {}
    for (i, _), f in zip(data, fp, strict=True):
        if i is not None:
            low[label[f]] = min(i, low.get(label[f], i))
    want = sorted(((i, f"{f:016x}", low.get(label[f])) for (i, _), f in zip(data, fp, strict=True)), key=repr)
    got = near_duplicates(edge.with_clashes(edge.frame(spark, data)))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert near_duplicates(edge.frame(spark, [])).collect() == []
    assert [tuple(r) for r in near_duplicates(edge.frame(spark, [(None, "a b c")])).select("doc_id", "component_id").collect()] == [(None, None)]


def some_fingerprints(seed):
    """Chains, dense clusters, borderline pairs and unrelated values."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1, 7, 15]
    for _ in range(6):                                     # chains of steps of three bits, and of four
        for step in (3, 4):
            x = r.getrandbits(64)
            for _ in range(12):
                for b in r.sample(range(64), step):
                    x ^= 1 << b
                out.append(x)
    for bits in (8, 30):                                   # many values that differ in few places
        x, places = r.getrandbits(64), r.sample(range(64), bits)
        out += [x ^ sum(1 << b for b in places if r.random() < 0.4) for _ in range(200)]
    return out


@pytest.mark.parametrize("groups,block", [(6, 1024), (6, 2), (7, 3), (8, 1024), (10, 5)])
def test_classes_match_brute_force(spark, groups, block, monkeypatch):
    from curatio.llm import simhash
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = some_fingerprints(groups + block)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    got = collections.defaultdict(set)
    for r in simhash.classes(df, groups).collect():
        got[r.component].add(r.fp % (1 << 64))
    want = collections.defaultdict(set)
    for f, k in classes_by_hand(fps).items():
        want[k].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_segment_counts_are_a_lower_bound(spark):
    from curatio.llm import simhash
    from pyspark.sql import functions as F
    r = random.Random(5)
    pairs = [tuple(r.getrandbits(64) - (1 << 63) for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.segment_counts(F.col("a")).alias("u"), simhash.segment_counts(F.col("b")).alias("v"))
    for x in df.select("a", "b", simhash.differing("u", "v").alias("d")).collect():
        count = lambda n: [bin((n % (1 << 64)) >> (2 * s) & 3).count("1") for s in range(32)]
        manhattan = sum(abs(p - q) for p, q in zip(count(x.a), count(x.b), strict=True))
        assert x.d == manhattan <= bin((x.a ^ x.b) % (1 << 64)).count("1")
    for g in range(6, 11):
        masks = simhash.cell_masks(g)
        assert len(masks) == math.comb(g, 3) and len(set(masks)) == len(masks)
    assert [simhash.group_number(n) for n in (1, 10**5, 10**6, 10**8, 10**12)] == sorted(simhash.group_number(n) for n in (1, 10**5, 10**6, 10**8, 10**12))
