"""Personal data by weak supervision, in DataFrame functions alone (operator 1).

Regular expressions give candidate spans with code-point offsets.  Four
labelers vote on each: the strict pattern with its check (Luhn, octet range,
digit count), a gazetteer (top-level domains, card issuers, country codes,
unroutable networks), the words before the span, and its boundary.  Expectation-
maximisation over the counts of vote patterns (at most 3**4 per kind, whatever
the corpus) estimates how reliable each labeler is; its posteriors train a
logistic span classifier, whose weights go back into a column expression.  Spans
the strict patterns accept always stay; the classifier adds others.

Defined cases: a null text counts as empty and has no spans; repeated rows and
null ids are handled row by row; without candidates the model adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["strict", "gazetteer", "context", "boundary"]
SHAPE = ["plus", "grouped", "long"]

# The four base patterns.  Possessive quantifiers and look-behinds change no match, they keep
# very long runs of one kind of character from being scanned again from every position in them.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what must be in a text at all
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+)+",
    "phone": r"(?<![0-9A-Za-z+().-]|[0-9][\x20])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|it|uk|nl|eu|us|ca|ch|at|be|br|mx|ar|jp|cn|in|au"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|3[068]|6011|64|65|62)"
COUNTRIES = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21|22|23|24|25|26|35|37|38|42|50|59|67|68|85|88|96|97|99)"
UNROUTABLE = r"^0*(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
NEAR = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|handy|telefon|t.l.phone",
}
AGAINST = r"version|release|invoice|order no|isbn|issn|license|section|chapter|\bid\b|\bref\b"


SPAN = "array<struct<start:int,end:int,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of a pattern's leftmost matches, offsets in code points.

    The texts between matches and the matches alternate, so running lengths are the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        here = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["out"], here).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), add, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The check behind a strict pattern."""
    number = digits(hit)
    n = F.length(number)
    if kind == "ip":
        octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return F.regexp_like(hit, F.lit(f"^{octet}(?:[.]{octet}){{3}}$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def describe(text: Column, s: Column, kind: str, strict: bool) -> Column:
    """The votes on one span and its shape."""
    hit, number = s["hit"], digits(s["hit"])
    ok = passes(kind, hit) if strict else F.lit(False)
    before = F.lower(F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40))))
    left, right = F.substring(text, s["start"], F.when(s["start"] > 0, 1).otherwise(0)), F.substring(text, s["end"] + 1, F.lit(1))
    listed = {"email": F.regexp_like(F.lower(hit), F.lit(rf"[.\])\x20]({DOMAINS})$")),
              "ip": ~F.regexp_like(hit, F.lit(UNROUTABLE)),
              "card": F.regexp_like(number, F.lit(ISSUERS)),
              "phone": F.regexp_like(number, F.lit(COUNTRIES if strict else "^[2-9]"))}[kind]
    glued = F.regexp_like(left, F.lit(r"[\p{L}0-9_.,-]")) | F.regexp_like(right, F.lit(r"[\p{L}0-9_]"))
    return F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), ok.alias("base"),
        vote(ok, F.lit(strict)).alias("strict"), vote(listed, ~listed).alias("gazetteer"),
        vote(F.regexp_like(before, F.lit(NEAR[kind])), F.regexp_like(before, F.lit(AGAINST))).alias("context"),
        vote(~glued, glued).alias("boundary"),
        F.startswith(hit, F.lit("+")).cast("int").alias("plus"),
        F.regexp_like(hit, F.lit(r"[0-9][\x20().-]+[0-9]")).cast("int").alias("grouped"),
        (F.length(hit) > 24).cast("int").alias("long"))


def _described(text: Column, spans: Column, kind: str, strict: bool) -> Column:
    return F.transform(spans, lambda s: describe(text, s, kind, strict))


def candidates(text: Column) -> Column:
    """array of candidate spans with their votes and shape, by start and then kind."""
    groups = []
    for kind in KINDS:
        found = matches(text, STRICT[kind])
        if NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(SPAN))
        groups.append(_described(text, found, kind, True))
        if kind in LOOSE:
            groups.append(_described(text, matches(text, LOOSE[kind]), kind, False))
    return F.array_sort(F.concat(*groups))


@dataclass
class SpanModel:
    """Labeler reliabilities and classifier weights by kind (index into KINDS)."""

    reliability: dict[int, dict[str, tuple[float, float]]]
    weights: dict[int, list[float]]


def estimate(rows: list[tuple], rounds: int = 30) -> tuple[dict[str, tuple[float, float]], list[float]]:
    """EM over one kind's vote patterns (votes..., count): P(vote yes | real), P(vote yes | not real) by
    labeler, and the posterior of each pattern.  Abstentions carry no evidence."""
    k = len(LABELERS)
    post = [min(0.99, max(0.01, 0.5 + 0.2 * sum(r[:k]))) for r in rows]
    rel = {}
    for _ in range(rounds):
        total = sum(r[k] for r in rows)
        real = sum(p * r[k] for p, r in zip(post, rows, strict=True))
        prior = min(0.99, max(0.01, real / total))
        rel = {}
        for j, name in enumerate(LABELERS):
            yes1 = sum(p * r[k] for p, r in zip(post, rows, strict=True) if r[j] > 0)
            any1 = sum(p * r[k] for p, r in zip(post, rows, strict=True) if r[j] != 0)
            yes0 = sum((1 - p) * r[k] for p, r in zip(post, rows, strict=True) if r[j] > 0)
            any0 = sum((1 - p) * r[k] for p, r in zip(post, rows, strict=True) if r[j] != 0)
            # a weak belief that a labeler is right keeps the two classes from swapping
            rel[name] = ((yes1 + 4) / (any1 + 5), (yes0 + 1) / (any0 + 5))
        post = []
        for r in rows:
            odds = math.log(prior / (1 - prior))
            for j, name in enumerate(LABELERS):
                a, b = rel[name]
                odds += math.log(a / b) if r[j] > 0 else math.log((1 - a) / (1 - b)) if r[j] < 0 else 0.0
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return rel, post


def fit_spans(found: DataFrame, column: str = "candidates", steps: int = 300, rate: float = 1.0, l2: float = 0.01) -> SpanModel:
    """EM and the span classifier from the counts of (kind, votes, shape): a table whose size the
    labelers bound, at most 4 * 81 * 8 rows."""
    counted = found.select(F.explode(column).alias("c")).groupBy(*[f"c.{x}" for x in ["kind", *LABELERS, *SHAPE]]).count().collect()
    reliability, weights = {}, {}
    for kind in range(len(KINDS)):
        rows = sorted(tuple(r[1:]) for r in counted if r["kind"] == kind)
        if not rows:
            continue
        k = len(LABELERS)
        by_votes: dict[tuple, int] = {}
        for r in rows:
            by_votes[r[:k]] = by_votes.get(r[:k], 0) + r[-1]
        patterns = [(*v, n) for v, n in sorted(by_votes.items())]
        reliability[kind], post = estimate(patterns)
        target = dict(zip((p[:k] for p in patterns), post, strict=True))
        xs = [([1.0, *map(float, r[:-1])], target[r[:k]], r[-1]) for r in rows]
        total = sum(n for *_, n in xs)
        w = [0.0] * (1 + k + len(SHAPE))
        for _ in range(steps):
            grad = [l2 * v for v in w]
            for x, y, n in xs:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for j, v in enumerate(x):
                    grad[j] += (p - y) * v * n / total
            w = [v - rate * g for v, g in zip(w, grad, strict=True)]
        weights[kind] = w
    return SpanModel(reliability, weights)


def accepted(found: Column, model: SpanModel, threshold: float = 0.5) -> Column:
    """The base spans, and other candidates the classifier accepts that touch no base span of their kind."""
    base = F.filter(found, lambda s: s["base"])
    if not model.weights:
        return base

    def probability(s: Column) -> Column:
        odds = F.lit(-100.0)
        for kind, w in model.weights.items():
            terms = F.lit(w[0])
            for v, name in zip(w[1:], [*LABELERS, *SHAPE], strict=True):
                terms = terms + F.lit(v) * s[name]
            odds = F.when(s["kind"] == kind, terms).otherwise(odds)
        return 1 / (1 + F.exp(-odds))

    def clear(s: Column) -> Column:
        return ~F.exists(base, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.filter(found, lambda s: s["base"] | ((probability(s) >= threshold) & clear(s)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    """Number of spans of one kind."""
    number = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans (arrays of candidate structs) of every whole text."""
    text = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    found = materialize(text.select("doc_id", candidates(F.col("text")).alias("candidates")))
    model = fit_spans(found)
    return found.select("doc_id", F.filter("candidates", lambda s: s["base"]).alias("base"), accepted(F.col("candidates"), model, threshold).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every accepted span replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null.  The candidates of the first pass only feed the counts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    model = fit_spans(docs.select(candidates(text).alias("candidates")))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.get(marks, s["kind"]))
        return F.struct(F.when(apart, out).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    def rebuilt(spans: Column) -> Column:
        return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                           lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))

    held = "_candidates"
    while held in docs.columns:
        held += "_"
    marked = docs.withColumn(held, accepted(candidates(text), model, threshold))
    return marked.withColumn(text_col, F.when(F.size(held) > 0, rebuilt(F.col(held))).otherwise(F.col(text_col))).drop(held)
