"""Exact-size seeded sampling, splits and shuffles.

Rows are ordered by a seeded MD5 of ``"<id>:<seed>"`` (portable: any
engine reproduces the same order) and numbered with
the scalable global rank (range-partitioned sort + per-partition
offsets), so an exact ``k`` of ``n`` rows is a filter on the rank: no
``orderBy().limit(k)`` that would pull ``k`` rows into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import rank_ids


def _hashed(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))))


def sample_exact(df: DataFrame, id_col: str, size: int | None = None, share: float | None = None,
                 seed: int = 42) -> DataFrame:
    """exactly ``size`` rows (or ``int(n * share)``) without
    replacement; when that is every row the input is returned as is."""
    n = df.count()
    k = size if size is not None else int(n * float(share))
    if k >= n:
        return df
    r = rank_ids(_hashed(df, id_col, seed), id_col, ["_h"], rank_col="_r")
    return df.join(r.filter(F.col("_r") < k).select(id_col), id_col, "left_semi")


def train_eval_split(df: DataFrame, id_col: str, train_share: float = 0.98, seed: int = 42) -> DataFrame:
    """seeded permutation, the first ``int(n * share)`` rows are train."""
    n = df.count()
    cut = int(n * train_share)
    r = rank_ids(_hashed(df, id_col, seed), id_col, ["_h"], rank_col="_r")
    split = F.when(F.col("_r") < cut, F.lit("train")).otherwise(F.lit("eval"))
    return df.join(r.select(id_col, split.alias("split")), id_col).select(*df.columns, "split")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """a reproducible order (global sort on the seeded hash)."""
    return _hashed(df, id_col, seed).orderBy("_h", id_col).drop("_h")


def shuffle_positions(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """``(id_col, place)``, each row's 0-based position in the seeded shuffle."""
    return rank_ids(_hashed(df, id_col, seed), id_col, ["_h"], rank_col="place")


def first_rows(df: DataFrame, n: int, id_col: str) -> DataFrame:
    """The first ``n`` rows by id (a top-n report)."""
    return df.orderBy(id_col).limit(n)
