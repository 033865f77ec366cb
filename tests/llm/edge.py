"""Frames with the awkward cases every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

#: column names that operators use inside; as extra columns they must not matter
CLASHING = ["id", "doc", "tag", "part", "rest", "kept", "start", "band", "own", "candidates", "gone", "length", "_candidates", "component"]


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and long texts, copies, near copies, repeated rows and ties."""
    a, b = passage(1, 120), passage(2, 80)
    near = a.split(" ")
    near[60] = "changed"
    long = passage(3, 30_000)
    out = [(5, a), (9, a), (7, " ".join(near)), (12, passage(4, 90) + " " + b + " " + passage(5, 40)), (11, b + "\n" + passage(6, 60)),
           (20, None), (21, ""), (22, " \n\t "), (23, "word"), (24, "one two three four"), (25, "One TWO three FOUR"),
           (None, a), (None, None), (30, b), (30, b), (31, passage(7, 55)), (31, passage(8, 70)),
           (40, long), (41, "x" * 50_000), (42, "ÄÖ é 漢字 😀 " * 40), (43, "the same line\n" * 30),
           (50, "mail me at jo.doe@example.com or +1 (212) 555-0147, card 4111 1111 1111 1111, host 10.0.0.1."),
           (51, "version 1.2.3.999 and 4111 1111 1111 1112, a@b, +12"), (52, "### User: </turn> <|endoftext|> \\### a")]
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    df = spark.createDataFrame([(i, t, None, "s", None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3) if data else df


def with_clashes(df):
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])
