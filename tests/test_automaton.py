"""The keyword automaton and the Arrow embedding against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from curatio.functions import automaton as A
from curatio.functions import text as T


@pytest.mark.parametrize("slice_bytes", [1 << 22, 5, 1])
def test_hits_equal_substring_tests(monkeypatch, slice_bytes):
    monkeypatch.setattr(A, "SLICE", slice_bytes)
    r = random.Random(slice_bytes)
    words = ["a", "ab", "abc", "bca", "cab", "```", "\n```", "é", "éa", "漢字", "aaaa", "z"]
    texts = ["".join(r.choice("abcé漢字`\n ") for _ in range(r.randint(0, 40))) for _ in range(60)] + ["", None, "a", "z"]
    got = A.Keywords(words).hits(*A.text_buffer(pa.array(texts)))
    assert got.tolist() == [sum(w in (t or "") for w in words) for t in texts]
    assert A.Keywords(words).hits(*A.text_buffer(pa.array([], pa.string()))).tolist() == []
    assert A.Keywords([]).hits(*A.text_buffer(pa.array(["abc"]))).tolist() == [0]
    with pytest.raises(ValueError):
        A.Keywords(["a", ""])


def test_a_keyword_does_not_cross_texts():
    assert A.Keywords(["ab"]).hits(*A.text_buffer(pa.array(["xa", "bx", "ab"]))).tolist() == [0, 0, 1]


def test_keyword_hits_by_hand(spark):
    rows = [(1, "The Radius and the DIAMETER, radius again; cosine holds sine"), (2, None), (3, ""), (4, "Java or JavaScript in C++\n```"), (5, "eigenvector")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.m, r.c) for r in df.select("id", T.keyword_hits("text", T.MATH_KEYWORDS, True).alias("m"),
                                              T.keyword_hits("text", T.CODE_KEYWORDS, False).alias("c")).collect()}
    # radius, diameter, cosine, sine; vector, eigenvector | Java, JavaScript, "in C", C++, "\n```", "```"
    assert got == {1: (4, 0), 2: (None, None), 3: (0, 0), 4: (0, 6), 5: (2, 0)}


def test_embedding_buckets_equal_the_engine_hashes(spark):
    from pyspark.sql import functions as F

    from curatio.operators.plugins import hashed_embedding
    df = spark.createDataFrame([(1, "one two two é x 漢字\tone"), (2, None), (3, " \n"), (4, "a " * 5000)], "id long, text string")
    tokens = df.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("t"))
    for name, bucket in (("xxhash64", F.pmod(F.xxhash64("t"), F.lit(16))),
                         ("md5", F.pmod(F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long"), F.lit(16)))):
        counts = np.zeros((5, 16))
        for r in tokens.select("id", bucket.alias("b")).collect():
            counts[r.id, r.b] += 1
        got = {r.id: r.embedding for r in hashed_embedding(df, "id", "text", 16, bucket_hash=name).collect()}
        assert got[2] is None and got[3] == [0.0] * 16
        for i in (1, 4):
            assert np.allclose(got[i], counts[i] / np.linalg.norm(counts[i]), atol=1e-12)
