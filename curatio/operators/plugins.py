"""Model plug-in contracts (K1-K7) and deterministic Spark defaults.

Neural inference is outside the engine: each plug-in takes a DataFrame
and returns one with an extra column.  A user-supplied plug-in is a
pandas function run with ``mapInPandas`` (Arrow batches per partition);
the defaults are Catalyst expressions so every operator runs and can be
tested with no model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generator = Callable[[pd.DataFrame], pd.DataFrame]   # (id, prompt) -> (id, text, error)


def default_generation(prompt: Column, label: str = "") -> Column:
    """The K1 default as an expression: a deterministic echo of the whole prompt."""
    return F.concat(F.lit(f"[{label or 'reply'}] "), prompt)


def generate(df: DataFrame, id_col: str, prompt_col: str, out_col: str = "generated",
             fn: Generator | None = None, label: str = "") -> DataFrame:
    """K1 text generation.  ``fn`` receives batches ``(id, prompt)`` and
    returns ``(id, text, error)``; rows whose generation failed come back
    with NULL text and an error message (B7 rejects them).  Default: a
    deterministic echo of the whole prompt."""
    if fn is None:
        return df.withColumn(out_col, default_generation(F.col(prompt_col), label)) \
                 .withColumn(f"{out_col}_error", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield fn(b.rename(columns={id_col: "id", prompt_col: "prompt"})[["id", "prompt"]])
            except Exception as e:  # noqa: BLE001  (whole batch failed)
                yield pd.DataFrame({"id": b[id_col], "text": None, "error": repr(e)})

    gen = (df.select(F.col(id_col), F.col(prompt_col))
           .mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, text string, error string"))
    return (df.join(gen.withColumnRenamed("id", id_col), id_col, "left")
            .withColumnRenamed("text", out_col).withColumnRenamed("error", f"{out_col}_error"))


def split_rejected(df: DataFrame, out_col: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their error)."""
    bad = F.col(out_col).isNull() | F.col(f"{out_col}_error").isNotNull()
    return df.filter(~bad), df.filter(bad)


#: tokens whose bucket a worker remembers, and cells of the count matrix of one slice
TOKENS_KEPT, CELLS = 1 << 18, 1 << 21
_TOKEN = re.compile(rb"[^ \t-\r]+")


def _bucket(token: bytes, dim: int, bucket_hash: str) -> int:
    if bucket_hash == "md5":
        return int.from_bytes(hashlib.md5(token).digest()[:4]) % dim
    h = xxhash.xxh64_intdigest(token, 42)
    return (h - (1 << 64) if h >> 63 else h) % dim


def hashed_embedding(df: DataFrame, id_col: str, text_col: str, dim: int = 64,
                     out_col: str = "embedding", bucket_hash: str = "xxhash64") -> DataFrame:
    """K2 default: hashed whitespace-token counts, L2-normalised; rows
    without tokens get the zero vector, a NULL text NULL.  Buckets are Spark's
    ``xxhash64`` of the token, or with ``bucket_hash="md5"`` the first 32 bits of its
    MD5, which any engine can recompute.

    One Arrow pass, no shuffle: a worker remembers the buckets of tokens it has met
    (at most ``TOKENS_KEPT``), and the counts of all texts of a slice are one bincount."""
    known: dict[bytes, int] = {}

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        parts, step = [], max(1, CELLS // dim)
        for at in range(0, len(texts), step):
            some = [t.encode() if t is not None else b"" for t in texts.slice(at, step).to_pylist()]
            places = []
            for i, text in enumerate(some):
                for token in _TOKEN.findall(text):
                    j = known.get(token)
                    if j is None:
                        if len(known) >= TOKENS_KEPT:
                            known.clear()
                        j = known[token] = _bucket(token, dim, bucket_hash)
                    places.append(i * dim + j)
            counts = np.bincount(np.array(places, np.int64), minlength=len(some) * dim).reshape(len(some), dim).astype(float)
            norm = np.sqrt((counts * counts).sum(1))
            parts.append(counts / np.maximum(norm, 1e-12)[:, None])
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        bounds = pa.array(np.arange(len(texts) + 1) * dim, pa.int32())
        return pa.ListArray.from_arrays(bounds, pa.array(flat), mask=texts.is_null())

    return df.withColumn(out_col, embed(F.col(text_col)))


def class_logits_from_counts(n: Column) -> Column:
    """K4 default: six class logits peaking at the length bucket."""
    bucket = F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(n / F.lit(20.0))))
    # bound once: inside the inner lambda it would be evaluated for every class
    return F.get(F.transform(F.array(bucket), lambda b: F.transform(
        F.sequence(F.lit(1), F.lit(6)), lambda k: -F.abs(k - b).cast("double"))), F.lit(0))


class BaseFilter:
    """K7: a selection step; subclasses implement ``transform``."""

    def transform(self, df: DataFrame) -> DataFrame:  # pragma: no cover - abstract
        raise NotImplementedError
