"""The document operators against brute force, on awkward rows and on the small tables."""

import hashlib
import zlib

import numpy as np
import pytest

import brute
import edge

SF = "/root/testdata/sf0.001"


def table(name):
    import duckdb
    return duckdb.connect().execute(f"SELECT doc_id, {name} FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def by_row(rows):
    return sorted(rows, key=repr)


# quality rules -------------------------------------------------------------------

def test_statistics_match_brute_force(spark):
    from curatio.llm.quality import BASE, document_statistics
    data = edge.rows() + table("text")
    got = by_row([(r.doc_id, *(r[k] for k in BASE)) for r in document_statistics(edge.with_clashes(edge.frame(spark, data))).collect()])
    assert got == by_row([(i, *brute.base_counts(t)) for i, t in data])


def test_quality_verdicts(spark):
    from curatio.llm.quality import quality_rules
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    for i, t in table("text"):
        n, _, _, _, repeated = brute.base_counts(t)
        assert got[i].base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (got[i].base_failed and got[i].kept)
    passed = [i for i in known if not got[i].base_failed]
    assert np.mean([got[i].kept == bool(known[i]) for i in passed]) > 0.95


def test_quality_without_labels_or_rows(spark):
    from curatio.llm.quality import quality_rules
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_rules(edge.frame(spark), none).collect()
    assert len(got) == len(edge.rows()) and all(r.kept != r.base_failed for r in got)
    assert quality_rules(edge.frame(spark, []), none).count() == 0
    odd = spark.createDataFrame([(5, 1), (None, 1), (7, None), (23, 0), (5, 1)], "doc_id long, quality int")
    kept = quality_rules(edge.with_clashes(edge.frame(spark)), odd, carry=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", *edge.CLASHING] and kept.count() > 0


def test_held_out_accuracy_and_monotone_scores(spark):
    from curatio.llm import quality as q
    r = np.random.RandomState(0)
    x = r.rand(4000, len(q.FEATURES))
    j = q.FEATURES.index("symbol_share")
    y = (x[:, j] + 0.3 * r.randn(4000) < 0.5).astype(float)
    m = q.fit_trees(x[:2000], y[:2000], np.array([q.MONOTONE.get(f, 0) for f in q.FEATURES]))
    assert ((m.score(x[2000:]) > 0) == y[2000:]).mean() > 0.75
    grid = np.repeat(x[:50], 21, axis=0)
    grid[:, j] = np.tile(np.linspace(0, 1, 21), 50)
    assert (np.diff(m.score(grid).reshape(50, 21), axis=1) <= 1e-12).all()


# near-duplicates -----------------------------------------------------------------

def _components(spark, data):
    from curatio.llm.minhash import near_duplicates
    return near_duplicates(edge.with_clashes(edge.frame(spark, data))).collect()


def test_near_duplicates_match_brute_force(spark):
    data = [(i, t) for i, t in edge.rows() if i is not None and i not in (30, 31)] + [(1000 + i, t) for i, t in table("text")]
    want = brute.near_components(data)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in _components(spark, data)}
    assert got == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in _components(spark, data[:10]))


def test_near_duplicates_null_and_repeated_ids(spark):
    got = _components(spark, edge.rows())
    assert len(got) == len(edge.rows())
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.component_id for r in got if r.doc_id in (5, 7, 9)} == {5}
    assert {r.component_id for r in got if r.doc_id == 30} == {30}
    assert _components(spark, []) == []


def test_links_that_only_the_block_search_finds(spark):
    """A chain: neighbours are alike, the bucket's first member is like one of them only."""
    words = edge.passage(9, 100).split(" ")
    data = []
    for k in range(12):
        w = list(words)
        w[8 * k: 8 * k + 1] = [f"new{k}"]
        w[(8 * k + 8) % 100: (8 * k + 8) % 100 + 1] = [f"new{k + 1}"]
        words = w
        data.append((100 - k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in _components(spark, data)}
    assert got == brute.near_components(data)


def test_packed_bits_estimate_similarity():
    import pyarrow as pa

    from curatio.llm import minhash as m
    a, b = edge.passage(11, 400).split(" "), edge.passage(11, 400).split(" ")
    b[200:230] = edge.passage(12, 30).split(" ")
    h, bounds, _ = m.shingle_sets(pa.array([" ".join(a), " ".join(b)]))
    mins = m.minima(h, bounds)
    bits = [(m.pack(mins)[:, i]) for i in range(2)]
    x = [int(p) ^ int(q) for p, q in zip(*bits, strict=True)]
    equal = 1 - sum(bin((v | v >> 1) & 0x5555555555555555).count("1") for v in x) / m.HASHES
    sa, sb = (set(h[bounds[i]: bounds[i + 1]].tolist()) for i in range(2))
    assert abs((equal - 0.25) / 0.75 - len(sa & sb) / len(sa | sb)) < 0.2


# repeated passages ---------------------------------------------------------------

@pytest.mark.parametrize("hot", [4096, 0])
def test_earlier_copies_match_brute_force(spark, hot, monkeypatch):
    from curatio.llm import suffix
    monkeypatch.setattr(suffix, "HOT", hot)
    data = [(i, t) for i, t in edge.rows() if i is not None and i not in (30, 31, 40)] + [(1000 + i, t) for i, t in table("text")]
    data += [(3000 + i, t) for i, t in enumerate(["a" * 200, "a" * 120, "ab" * 80, "x" * 49, "é" * 60, "é" * 25 + "z"])]
    got = {r.doc_id: tuple(r)[1:] for r in suffix.remove_earlier_copies(edge.with_clashes(edge.frame(spark, data)), with_bytes=False).collect()}
    assert got == brute.earlier_copies(data)


def test_earlier_copies_odd_rows(spark):
    from curatio.llm.suffix import remove_earlier_copies, without_earlier_copies
    got = remove_earlier_copies(edge.frame(spark))
    rows = got.collect()
    assert len(rows) == len(edge.rows())
    assert all(r.n_removed == 0 for r in rows if r.doc_id in (None, 5, 11, 31))
    assert [r.n_removed for r in rows if r.doc_id == 30] == [len(edge.passage(2, 80))] * 2
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in rows)
    assert remove_earlier_copies(edge.frame(spark, [])).count() == 0
    text = without_earlier_copies(edge.with_clashes(edge.frame(spark)))
    assert text.columns == ["doc_id", "text", "lang", "source", "n_chars", *edge.CLASHING]
    assert {r.text for r in text.collect() if r.doc_id == 20} == {None}


def test_previous_factors_match_brute_force():
    from curatio.llm.suffix_core import previous_factors
    r = np.random.RandomState(2)
    for _ in range(200):
        n = r.randint(1, 12)
        doc, lcp = r.randint(0, 5, n), r.randint(0, 9, n)
        lcp[0] = 0
        want = [max([0, *(min(lcp[min(i, j) + 1: max(i, j) + 1]) for j in range(n) if doc[j] < doc[i])]) for i in range(n)]
        assert previous_factors(lcp, doc).tolist() == want


# near-duplicate passages ---------------------------------------------------------

def test_passages_of_fifty_words_are_found(spark):
    from curatio.llm.compact import near_duplicate_passages
    data = [(1000 + i, t) for i, t in table("text")] + edge.rows()
    first, need = {}, set()
    for i, t in sorted(((i, t) for i, t in data if i is not None), key=lambda x: x[0]):
        w = brute.WORD.findall((t or "").lower())
        for j in range(len(w) - 50):
            if first.setdefault(tuple(w[j:j + 51]), i) < i:
                need.add(i)
    got = near_duplicate_passages(edge.with_clashes(edge.frame(spark, data))).collect()
    assert need <= {r.doc_id for r in got}
    texts = {}
    for i, t in data:
        texts.setdefault(i, []).append("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for r in got[:200]:
        best = 0.0
        for x in texts[r.doc_id]:
            for y in texts[r.match_doc_id]:
                a = brute.shingle_set(" ".join(brute.WORD.findall(x)[r.start_word: r.end_word]))
                b = brute.shingle_set(" ".join(brute.WORD.findall(y)[r.match_start_word: r.match_end_word]))
                best = max(best, len(a & b) / max(1, len(a | b)))
        assert best >= 0.75 and r.end_word - r.start_word >= 50 and r.match_doc_id < r.doc_id
    assert near_duplicate_passages(edge.frame(spark, [])).count() == 0


def _best_pair(a, b, width):
    """Largest similarity of two stretches of at least width shingles, by trying equal lengths everywhere."""
    best = 0.0
    for n in range(width, min(len(a), len(b)) + 1):
        sets = [[set(x[i:i + n].tolist()) for i in range(len(x) - n + 1)] for x in (a, b)]
        best = max([best, *(len(p & q) / len(p | q) for p in sets[0] for q in sets[1])])
    return best


def _edited(r, passage, n):
    out = passage.copy()
    out[r.choice(len(out), n, replace=False)] = r.randint(1 << 40, 1 << 41, n)
    return out


def test_passages_beside_shared_lines_match_brute_force():
    from curatio.llm.compact import common_passages
    r = np.random.RandomState(7)

    def fresh(n):
        return r.randint(0, 1 << 40, n)

    def join(*parts):
        return np.concatenate(parts).astype(np.uint64)

    for k in range(12):
        p, line = fresh(60), fresh(40)
        near = _edited(r, p, 4 + k % 4)                                  # 0.79 - 0.87
        pairs = [(join(fresh(5), near, fresh(14), line), join(fresh(9), p, fresh(30), line)),     # an exact run beside it
                 (join(line, fresh(14), near), join(p, fresh(20), line)),
                 (join(near, fresh(6)), join(p[10:50], fresh(50), p)),                            # part of it once more in b
                 (join(fresh(70), line), join(line[:30], fresh(80)))]                             # no passage
        for a, b in pairs[: 4 if k < 2 else 3]:
            want = _best_pair(a, b, 46) >= 0.75 if k < 2 else True
            got = common_passages(a, b, 75, 46)
            assert bool(got) == want
            for a0, a1, b0, b1, inter, union in got:
                x, y = set(a[a0:a1].tolist()), set(b[b0:b1].tolist())
                assert (inter, union) == (len(x & y), len(x | y)) and 4 * inter >= 3 * union and min(a1 - a0, b1 - b0) >= 46
        line = fresh(26)
        a = join(*[x for _ in range(10) for x in (line, fresh(4))], fresh(30), p, fresh(3))
        got = common_passages(a, join(line, fresh(40), p), 75, 46)
        assert any(x[0] <= 330 and x[1] >= 390 for x in got)             # the line ten times, then the passage
        a[330:390] = near.astype(np.uint64)
        assert any(x[0] < 360 < x[1] for x in common_passages(a, join(line, fresh(40), p), 75, 46))


def test_passages_behind_shared_parts_and_versions_are_found(spark):
    """The first holders of a passage's keys hold only parts of it; versions are like the version before only."""
    from curatio.llm.compact import near_duplicate_passages
    data, need = [], {}
    for k in range(12):
        p, at, n = edge.passage(500 + k, 60).split(" "), 1000 * k, 42 if k < 8 else 45       # 45 words pass by themselves
        for i in range(3):
            data += [(at + i, " ".join([edge.passage(at + 10 + i, 30), *p[:n], edge.passage(at + 20 + i, 30)])),
                     (at + 4 + i, " ".join([edge.passage(at + 30 + i, 30), *p[-n:], edge.passage(at + 40 + i, 30)]))]
        for i in range(2):
            data.append((at + 50 + i, " ".join([edge.passage(at + 50 + i, 20 + 7 * i), *p, edge.passage(at + 60 + i, 30)])))
        need[at + 51] = {at + 50}
    for k in range(6):
        lines, at = [edge.passage(700 + 2 * k + i, 30) for i in (0, 1)], 50_000 + 1000 * k       # two lines, each common
        data += [(at + i, "\n".join([edge.passage(at + 10 + i, 25), lines[i % 2], edge.passage(at + 30 + i, 25)])) for i in range(8)]
        data += [(at + 20 + i, "\n".join([edge.passage(at + 50 + i, 25), *lines, edge.passage(at + 60 + i, 25)])) for i in range(2)]
        need[at + 21] = {at + 20}
    words = edge.passage(900, 100).split(" ")
    for v in range(12):
        words[8 * v: 8 * v + 3] = [f"new{v}{x}" for x in "abc"]
        data.append((90_000 + v, " ".join(words)))
    rows = [(i, brute.WORD.findall(t)) for i, t in data if i >= 90_000]
    for v in range(1, 12):
        mine = brute.shingle_set(" ".join(rows[v][1]))
        need[90_000 + v] = {i for i, w in rows[:v] for s in [brute.shingle_set(" ".join(w))] if 4 * len(s & mine) >= 3 * len(s | mine)}
    got = {}
    for r in near_duplicate_passages(edge.frame(spark, data)).collect():
        assert r.match_doc_id < r.doc_id and 4 * r.n_common >= 3 * r.n_union and r.end_word - r.start_word >= 50
        got.setdefault(r.doc_id, set()).add(r.match_doc_id)
    missed = {i: want for i, want in need.items() if want and not got.get(i)}
    assert not missed and all(got[i] & want for i, want in need.items() if i < 8000 or 50_000 <= i < 90_000), {i: (got[i], want) for i, want in need.items()}


def test_compact_windows_are_the_cartesian_tree_nodes():
    from curatio.llm.compact import compact_windows
    r = np.random.RandomState(1)
    for _ in range(20):
        bounds = np.concatenate([[0], np.cumsum(r.randint(0, 80, 5))])
        v = r.randint(0, 50, bounds[-1]).astype(np.uint64) << np.uint64(30)
        want = set()
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            for p in range(lo, hi):
                x, y = p, p
                while x > lo and v[x - 1] > v[p]:
                    x -= 1
                while y + 1 < hi and v[y + 1] >= v[p]:
                    y += 1
                if y - x + 1 >= 7:
                    want.add((p, x, y))
        assert set(zip(*(c.tolist() for c in compact_windows(v, bounds, 7)), strict=True)) == want


# personal data -------------------------------------------------------------------

def test_base_spans_match_brute_force(spark):
    import random

    from curatio.llm import pii
    r = random.Random(5)
    parts = ["1", "22", "255", "256", "4", ".", ".", "-", " ", "+", "(", ")", "@", "a", "B.c", "é", "😀", "_", "\n", "4111111111111111", "mail", "555"]
    data = edge.rows() + [(10_000 + i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(800)]
    data += [(90_000, "1" * 60_000), (90_001, "a" * 60_000 + "@"), (90_002, "1." * 20_000), (90_003, "a@b" + ".c" * 20_000)]
    found = pii.find_personal_data(edge.with_clashes(edge.frame(spark, data)))
    got = by_row([(x[0], x[1]) for x in found.select("doc_id", pii.listed(found.base)).collect()])
    assert got == by_row([(i, ",".join(f"{brute.PII[k][0]}:{s}:{e}" for s, k, e in brute.base_spans(t))) for i, t in data])
    assert pii.find_personal_data(edge.frame(spark, [])).count() == 0


def test_classifier_adds_spans_and_redaction_takes_them(spark):
    from curatio.llm import pii
    data = [(i, f"call {name} at +1 (212) 555-01{i:02d} or mail {name}@example.com today") for i, name in enumerate(["ann", "bob", "cid"] * 8)]
    data += [(100, "please call 212-555-0199 or mail jo [at] example [dot] com"), (101, None), (102, "version 3.4.5.6.7 of 2024")]
    found = pii.find_personal_data(edge.frame(spark, data))
    spans = {r[0]: r[1] for r in found.select("doc_id", pii.listed(found.spans)).collect()}
    assert spans[100].startswith("phone:12:24,email:33:") and spans[102] == "ip:8:15"
    out = {r.doc_id: r.text for r in pii.redact(edge.with_clashes(edge.frame(spark, data))).collect()}
    assert out[0] == "call ann at [PHONE] or mail [EMAIL] today" and out[101] is None
    assert out[100] == "please call [PHONE] or mail [EMAIL]"


def test_reliabilities_prefer_the_labelers_that_agree():
    from curatio.llm.pii import estimate
    rows = [(1, 1, 0, 1, 90), (-1, -1, 0, 1, 60), (1, 1, 0, -1, 10), (-1, -1, 0, -1, 8)]
    rel, post = estimate(rows)
    assert rel["strict"][0] > 0.9 > 0.2 > rel["strict"][1] and abs(rel["boundary"][0] - rel["boundary"][1]) < 0.2
    assert post[0] > 0.9 and post[1] < 0.1


# fingerprints --------------------------------------------------------------------

def test_fingerprints_match_sets(spark):
    import re

    from curatio.llm.fingerprint import fingerprints
    data = [(i, t) for i, t in edge.rows() if i is not None and i not in (30, 31, 40)]
    got = {r.doc_id: r for r in fingerprints(edge.with_clashes(edge.frame(spark, data))).collect()}
    ordered = sorted((i, t or "") for i, t in data)

    def parts(t):
        return {p for p in re.split(r"\n|(?<=[.!?])\x20", t) if p}

    def alike(x, y):
        return 1.0 if not x | y else len(x & y) / len(x | y)

    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(parts(t), parts(edited))) and r.near_next == pytest.approx(alike(parts(t), parts(after)))
    assert got[5].fingerprint == got[9].fingerprint != got[7].fingerprint


def test_fingerprints_odd_rows(spark):
    from curatio.llm.fingerprint import fingerprints
    few = [(i, t) for i, t in edge.rows() if t is None or len(t) < 2000]
    assert fingerprints(edge.frame(spark, few)).count() == len(few)
    assert fingerprints(edge.frame(spark, [])).count() == 0
    (one,) = fingerprints(edge.frame(spark, [(3, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


@pytest.mark.parametrize("rounds,tries", [(12, 8), (12, 1), (0, 2)])
def test_likeness_is_exact_whatever_stays_hidden(spark, rounds, tries, monkeypatch):
    from pyspark.sql import functions as F

    from curatio.llm import fingerprint as f
    monkeypatch.setattr(f, "ROUNDS", max(rounds, 1))
    monkeypatch.setattr(f, "TRIES", tries)
    if rounds == 0:
        monkeypatch.setattr(f, "THIRD", 1)                                  # nothing can be peeled
    data = [(i, "\n".join(f"{i % 3} {k}" if k % 4 else f"all {k}" for k in range(n))) for i, n in enumerate([0, 3, 40, 300, 1500, 1501])]
    sets = {i: set(t.split("\n")) - {""} for i, t in data}
    d = edge.frame(spark, data).select("doc_id", f.digests(F.col("text")).alias("k"))
    d = d.crossJoin(d.toDF("other", "l")).withColumn("x", f.base_sketch(F.col("k"))).withColumn("y", f.base_sketch(F.col("l")))
    for i, j, got in d.select("doc_id", "other", f.likeness(F.col("k"), F.col("l"), F.col("x"), F.col("y"))).collect():
        a, b = sets[i], sets[j]
        assert got == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)


def test_likeness_of_fifty_thousand_lines(spark):
    from curatio.llm.fingerprint import fingerprints
    long = "\n".join(f"line {k}" for k in range(50_000))
    got = {r.doc_id: r for r in fingerprints(edge.frame(spark, [(1, long), (2, "line 7\nline x")])).collect()}
    assert got[1].near_next == got[2].near_next == pytest.approx(1 / 50_001)
    assert got[1].near_edited is not None and got[2].near_edited is not None


# encoding, packing, token files --------------------------------------------------

def _tokenizer(name):
    import public_tokenizers

    from curatio.llm import encode
    return public_tokenizers.path(name), encode.load(public_tokenizers.path(name))


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_cached_encoding_equals_the_library(name, kind):
    import random

    from curatio.llm import encode
    path, tok = _tokenizer(name)
    r = random.Random(3)
    parts = [*"ab \n'st\t\x1c\x85\xa0 éÉΣς9٣<|>#́İß.,", "<|endoftext|>", "'ll", "  ", " \n", "漢字", "😀"]
    texts = [t or "" for _, t in edge.rows()] + [t for _, t in table("text")][:60] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    own = encode.encoder(path, kind)
    for t in texts:
        assert np.frombuffer(own(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:200]


def test_packing_places_every_id_once(spark):
    from curatio.llm import packing
    path, tok = _tokenizer("byte_bpe_50k.json")
    data = edge.rows() + [(1000 + i, t) for i, t in table("text")]
    packed = packing.pack(packing.token_pieces(edge.with_clashes(edge.frame(spark, data)), path, end_id=1))
    rows = packed.collect()
    want = by_row([(i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in data])
    assert by_row([(r.doc_id, r.doc_tokens) for r in rows if r.start == 0]) == want
    assert sum(r.length for r in rows) == sum(n for _, n in want) and all(len(r.ids) == 4 * r.length for r in rows)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(len(fill))) and max(fill.values()) <= 2048
    out = {s.sequence_id: s for s in packing.sequences(packed).collect()}
    assert all(len(s.ids) == 4 * (s.tokens if s.tokens & (s.tokens - 1) == 0 else 2048) for s in out.values()) and len(out) == len(fill)
    assert packing.pack(packing.token_pieces(edge.frame(spark, []), path, end_id=1)).count() == 0


def test_histogram_packing_is_tight_and_complete():
    from curatio.llm.packing import pack_histogram
    r = np.random.RandomState(4)
    lengths, counts = np.unique(np.minimum(2048, r.geometric(0.003, 50_000)), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    packs = pack_histogram(histogram)
    used = {}
    for items, n in packs:
        assert sum(items) <= 2048
        for x in items:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    assert sum(k * n for k, n in histogram.items()) / (2048 * sum(n for _, n in packs)) > 0.98


def test_token_files_round_trip(spark, tmp_path):
    from curatio.llm import tokenfile
    path, tok = _tokenizer("word_bpe_49k.json")
    data = [(i, t) for i, t in edge.rows() if i not in (31,)]
    for name, some in (("all", data), ("none", [])):
        tokenfile.write_tokens(edge.with_clashes(edge.frame(spark, some)), str(tmp_path / name), path, end_id=2)
        got = sorted(tokenfile.read_tokens(spark, str(tmp_path / name)).collect(), key=lambda r: r.start)
        assert len(got) == len(some)
        at = 0
        for r in got:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens
        ids = [r.doc_id for r in got]
        assert ids == sorted(i for i, _ in some if i is not None) + [None] * sum(i is None for i, _ in some)
        want = by_row([(i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t in some])
        assert by_row([(r.doc_id, zlib.crc32(r.ids)) for r in got]) == want


def test_range_coder_round_trip_and_checksums():
    from curatio.llm.rangecoder import decode_blocks, encode_blocks
    r = np.random.RandomState(0)
    for x in (np.zeros(0, int), np.array([5]), r.randint(0, 65536, 20_000), np.zeros(9000, int), r.randint(0, 3, 9000)):
        blocks = encode_blocks(x)
        assert np.concatenate([*decode_blocks(blocks), np.zeros(0, int)]).tolist() == x.tolist()
    text = np.tile(r.randint(0, 49_000, 500), 16)
    blocks = encode_blocks(text)
    assert sum(map(len, blocks)) < len(text)            # under 8 bits an id
    broken = bytearray(blocks[0])
    broken[30] ^= 1
    with pytest.raises(ValueError):
        decode_blocks([bytes(broken)])


def test_rank_encoding_equals_tiktoken_and_decodes(spark):
    import public_tokenizers as P
    import tiktoken

    from curatio.llm import byte_bpe as b
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.read_ranks(path), special_tokens={})
    data = edge.rows() + [(1000 + i, t) for i, t in table("text")]
    rows = b.decode_ids(b.encode_texts(edge.with_clashes(edge.frame(spark, data)), path, P.PATTERN, offsets=True), path).collect()
    got = by_row([(r.doc_id, r.decoded, r.ids) for r in rows])
    assert got == by_row([(i, (t or "").encode(), np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in data])
    for r in rows:
        assert r.offsets[0] == 0 and r.offsets[-1] == len(r.decoded) and len(r.offsets) == r.n_tokens + 1
    ids = np.array(enc.encode_ordinary("漢字 😀 é"), "<u4")
    assert "".join(b.token_texts(ids, path)) == "漢字 😀 é"
    with pytest.raises(ValueError):
        b.decode_bytes(np.array([60_000]), path)
    assert b.encode_texts(edge.frame(spark, []), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("block,crowd", [(2, 4096), (3, 0), (256, 0), (2, 1)])
def test_several_blocks_and_crowded_ones_match_brute_force(spark, block, crowd, monkeypatch):
    """Clusters of versions in buckets that hold several components and blocks."""
    from curatio.llm import minhash
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CROWD", crowd)
    r = np.random.RandomState(block + crowd)
    data, at = [], 0
    for seed in range(4):
        base = edge.passage(100 + seed, 90).split(" ")
        for _ in range(9):
            w = list(base)
            for k in r.choice(90, r.randint(0, 6), replace=False):
                w[k] = f"v{r.randint(50)}"
            data.append((int(1000 - 7 * at), " ".join(w)))
            at += 1
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in _components(spark, data)}
    assert got == brute.near_components(data)


def test_sets_in_several_slices_match_brute_force(spark, monkeypatch):
    from curatio.llm import minhash
    monkeypatch.setattr(minhash, "SETS", 3)
    monkeypatch.setattr(minhash, "CROWD", 0)
    base = edge.passage(200, 80).split(" ")
    data = [(k, " ".join(base[: 3 * k] + [f"n{k}"] + base[3 * k + 1:])) for k in range(25)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in _components(spark, data)}
    assert got == brute.near_components(data)


def test_sets_hashed_in_slices_equal_those_hashed_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from curatio.llm import minhash, words

    texts = pa.array(["a b c d e f g", None, "", "one", "x y z x y z x y z " * 40, "a b c d e f g"] * 5, pa.large_string())
    whole = minhash.shingle_sets(texts)
    for size in (1, 64, 1 << 20):
        monkeypatch.setattr(words.chunks, "__defaults__", (size,))
        h, bounds = minhash.sets_of_many(texts)
        assert np.array_equal(bounds, whole[1]) and all(
            set(h[s:e]) == set(whole[0][s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True))
    assert [len(x) for x in minhash.sets_of_many(texts[:0])] == [0, 1]


def test_versions_of_a_passage_are_linked_with_each_other(spark):
    """Three versions, each like the two before it: the second link of the third is no less a link."""
    from curatio.llm.compact import near_duplicate_passages
    data, want = [], set()
    for k in range(4):
        words, at = edge.passage(7000 + k, 150).split(" "), 100 * k
        for v in range(4):
            mine = list(words)
            mine[20 + 30 * v] = f"other{v}"
            data.append((at + v, " ".join(mine)))
            want |= {(at + v, at + u) for u in range(v)}
        data.append((at + 9, data[-1][1]))           # a copy is linked with its text
        want.add((at + 9, at + 3))                   # its links with other texts are those of the text
    rows = near_duplicate_passages(edge.frame(spark, data)).collect()
    got = {(r.doc_id, r.match_doc_id) for r in rows}
    assert want <= got and all(4 * r.n_common >= 3 * r.n_union for r in rows)


def test_repeated_words_are_searched_as_one_region(spark, monkeypatch):
    """A run of one word has a window for each place; they meet the runs of other documents once, not place by place."""
    from curatio.llm import compact
    data = [(10 + i, " ".join([edge.passage(8000 + i, 30), *["the"] * (150 + i), edge.passage(8100 + i, 30)])) for i in range(12)]
    copied = edge.passage(8200, 70)
    data += [(40 + i, edge.passage(8300 + i, 40) + " " + copied + " " + edge.passage(8400 + i, 40)) for i in range(4)]
    met, search = [], compact._second_search

    def counted(*args):
        met.append(search(*args))
        return met[0]

    monkeypatch.setattr(compact, "_second_search", counted)
    got = {(r.doc_id, r.match_doc_id) for r in compact.near_duplicate_passages(edge.frame(spark, data)).collect()}
    assert {(10 + i, 10 + j) for i in range(12) for j in range(i)} | {(40 + i, 40) for i in range(1, 4)} <= got
    assert met[0].count() <= 2 * compact.FUNCTIONS * 12 * 11


def test_shuffle_files_of_the_passage_search_go_with_their_step(spark):
    """Every step is written out; its shuffle files used to stay on disk until the driver collected its garbage."""
    import time

    from curatio.llm.compact import near_duplicate_passages

    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(i).getName()): files.apply(i).length() for i in range(files.size())}

    copied = edge.passage(8500, 70)
    data = [(i, edge.passage(8600 + i, 40) + " " + copied + " " + edge.passage(8700 + i, 40)) for i in range(8)]
    before, until = set(held()), time.time() + 30
    got = near_duplicate_passages(edge.frame(spark, data))
    while (left := sum(n for x, n in held().items() if x.startswith("shuffle_") and x not in before)) > 5_000 and time.time() < until:
        time.sleep(1)
    assert left <= 5_000
    assert {(r.doc_id, r.match_doc_id) for r in got.collect()} >= {(i, 0) for i in range(1, 8)}


def test_slices_and_blocks_of_the_passage_search_change_nothing(spark, monkeypatch):
    from curatio.llm import compact
    words, data = edge.passage(8800, 90).split(" "), []
    for i in range(16):
        mine = list(words)
        mine[5 * i: 5 * i + 2] = [f"x{i}", f"y{i}"]
        data.append((i, " ".join([edge.passage(8900 + i, 20 + i), *mine, *["so"] * (60 + i % 3)])))

    def found():
        return sorted(map(tuple, compact.near_duplicate_passages(edge.frame(spark, data)).collect()))

    want = found()
    search, asked = compact._second_search, []
    monkeypatch.setattr(compact, "_second_search", lambda *args: (asked.append(args), search(*args))[1])
    for name, value in (("BLOCK", 4), ("FEW", 3), ("PAIRS", 4)):
        monkeypatch.setattr(compact, name, value)
    assert found() == want and len({r[:1] + r[3:4] for r in want}) >= 15 and len(asked) > 1
