"""Brute-force versions the operators are held against on small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    t = text or ""
    words = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def shingle_set(text, width=5):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    if not w:
        return set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def near_components(rows, percent=75):
    """doc_id -> (set size, component) by an inverted index over all shingles."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = collections.defaultdict(list)
    for i in sorted(sets):
        inter = collections.Counter(j for s in sets[i] for j in index[s])
        for j, n in inter.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def earlier_copies(rows, width=50):
    """doc_id -> (bytes, removed bytes, spans, sha256 of the rest)."""
    first: dict[bytes, int] = {}
    out = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first.setdefault(b[p:p + width], i) < i:
                gone[p:p + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


PII = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
       ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
       ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
       ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]


def base_spans(text):
    """(start, kind number, end) of the base personal data."""
    out = []
    for number, (kind, pattern) in enumerate(PII):
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m[0].split("."))
            elif kind == "card":
                total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
                ok = 14 <= len(d) <= 19 and total % 10 == 0
            elif kind == "phone":
                ok = 10 <= len(d) <= 15
            if ok:
                out.append((m.start(), number, m.end()))
    return sorted(out)
