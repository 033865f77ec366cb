"""Rademacher random projection of long vectors.

Sign ``s(i, j)`` of input component ``i`` for output component ``j`` is the
parity of the popcount of ``(i*A + j*B + seed*C) mod 2^32``: a counter-based
hash, so every task derives the same matrix from (seed, i, j) with no
shuffle or broadcast, and any engine can recompute it.  Rows are projected
per Arrow batch with one matrix product; the matrix is built in blocks of
output components so its memory stays bounded for long vectors.
``out = x @ S / sqrt(k)`` (norms preserved in expectation).

Vectors longer than a row come as blocks (``project_blocks``) or as single entries
(``project_entries``).  Smaller outputs use the first signs of the largest, so one
pass serves all sizes.  Each Arrow batch sums what it holds of a row, Spark sums the
rest by (row, component): a vector that fills many files is never one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Hash multipliers of the sign function.
MULT_I, MULT_J, MULT_SEED = 2654435761, 2246822519, 3266489917
_MOD = 1 << 32


def _popcount32(h: np.ndarray) -> np.ndarray:
    h = h - ((h >> 1) & 0x55555555)
    h = (h & 0x33333333) + ((h >> 2) & 0x33333333)
    h = (h + (h >> 4)) & 0x0F0F0F0F
    return ((h * 0x01010101) & 0xFFFFFFFF) >> 24


def sign_block(dim: int, j0: int, j1: int, seed: int) -> np.ndarray:
    """Signs for input components 0..dim-1 and output components j0..j1-1."""
    return signs(np.arange(dim, dtype=np.int64), j0, j1, seed)


def signs(inputs: np.ndarray, j0: int, j1: int, seed: int) -> np.ndarray:
    """Signs for any input components (of 64 bits) and output components j0..j1-1."""
    i = (inputs % _MOD)[:, None]          # the product is taken modulo 2^32 anyway
    j = np.arange(j0, j1, dtype=np.int64)[None, :]
    h = (i * MULT_I % _MOD + j * MULT_J + seed * MULT_SEED) % _MOD
    return np.where(_popcount32(h) % 2 == 0, 1.0, -1.0)


def project(df: DataFrame, vec_col: str, k: int, seed: int = 0, out_col: str = "proj",
            block_out: int = 1024) -> DataFrame:
    """Every row's vector projected to ``k`` components (dense path)."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType
    schema = StructType(list(df.schema.fields)).add(out_col, ArrayType(DoubleType()))
    scale = 1.0 / np.sqrt(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for b in batches:
            if len(b) == 0:
                yield b.assign(**{out_col: []})
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in b[vec_col].values])
            dim = x.shape[1]
            parts = []
            for j0 in range(0, k, block_out):
                key = (dim, j0)
                if key not in cache:
                    cache[key] = sign_block(dim, j0, min(k, j0 + block_out), seed)
                parts.append(x @ cache[key])
            y = np.hstack(parts) * scale
            yield b.assign(**{out_col: list(y)})

    return df.mapInPandas(run, schema)


def _summed(partials: DataFrame, row_col: str, sizes) -> DataFrame:
    """(row, size, j, value) from partial sums (row, piece, sums of ``PIECE`` components)."""
    each = partials.select(row_col, "piece", F.posexplode("sums").alias("p", "v"))
    total = each.groupBy(row_col, (F.col("piece") * PIECE + F.col("p")).cast("long").alias("j")).agg(F.sum("v").alias("v"))
    size = F.explode(F.filter(F.array(*[F.lit(int(k)).cast("long") for k in sorted(set(sizes))]), lambda k: k > F.col("j"))).alias("size")
    return total.select(row_col, size, "j", "v").select(row_col, "size", "j", (F.col("v") / F.sqrt(F.col("size"))).alias("value"))


def _partial_schema(df: DataFrame, row_col: str):
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
    return StructType([StructField(row_col, df.schema[row_col].dataType), StructField("piece", IntegerType()),
                       StructField("sums", ArrayType(DoubleType()))])


#: output components of one partial row, and signs held at once (32 MB of doubles)
PIECE, SIGNS = 1024, 1 << 22


def _batch_rows(col: pd.Series) -> tuple[np.ndarray, pd.Series]:
    """The row number of each line within the batch, and the rows (a NULL row is a row)."""
    codes, found = pd.factorize(col, use_na_sentinel=False)
    return codes, pd.Series(found, dtype=object).where(lambda x: ~pd.isna(x), None)


def _pieces(batches, row_col: str, k: int, add) -> Iterator[pd.DataFrame]:
    """Per batch and piece of outputs the sums of each row; ``add(batch, codes, sums, j0, j1)`` fills them."""
    for b in batches:
        if len(b) == 0:
            continue
        codes, found = _batch_rows(b[row_col])
        for j0 in range(0, k, PIECE):
            j1 = min(k, j0 + PIECE)
            sums = np.zeros((len(found), j1 - j0))
            add(b, codes, sums, j0, j1)
            yield pd.DataFrame({row_col: found, "piece": j0 // PIECE, "sums": list(sums)})


def project_entries(df: DataFrame, row_col: str, index_col: str, value_col: str, sizes, seed: int = 0) -> DataFrame:
    """H33, sparse: rows given as entries (row, component, value) projected to every size of
    ``sizes``; returns (row, size, j, value).

    Entries of one component add up; a NULL value or component counts as nothing, so a row with
    no other entry is all zeros.  Components are any 64-bit integers from 0."""
    k = max(sizes)

    def add(b, codes, sums, j0, j1):
        known = (b[index_col].notna() & b[value_col].notna()).to_numpy()
        order = np.argsort(codes[known], kind="stable")
        rows, i = codes[known][order], b[index_col][known].to_numpy(np.int64)[order]
        v = b[value_col][known].to_numpy(np.float64)[order]
        step = max(1, SIGNS // (j1 - j0))
        for a in range(0, len(i), step):
            part = rows[a:a + step]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums[part[first]] += np.add.reduceat(v[a:a + step, None] * signs(i[a:a + step], j0, j1, seed), first, axis=0)

    entries = df.select(row_col, F.col(index_col).cast("long").alias(index_col), F.col(value_col).cast("double").alias(value_col))
    return _summed(entries.mapInPandas(lambda it: _pieces(it, row_col, k, add), _partial_schema(df, row_col)), row_col, sizes)


def project_blocks(df: DataFrame, row_col: str, block_col: str, values_col: str, block_size: int, sizes, seed: int = 0) -> DataFrame:
    """H33, long vectors: rows given as blocks (row, block, values), component ``block * block_size + p``
    at place p, projected to every size of ``sizes``; returns (row, size, j, value).

    A block may be short (the rest is zero), absent or NULL (all zero); a longer one is an error."""
    k = max(sizes)

    def add(b, codes, sums, j0, j1):
        known = b[b[block_col].notna() & b[values_col].notna()].index.to_numpy()
        for block, at in pd.Series(known).groupby(b[block_col].loc[known].to_numpy(np.int64)):
            at = at.to_numpy()
            x = np.zeros((len(at), block_size))
            for n, v in enumerate(b[values_col].loc[at]):
                x[n, :len(v)] = np.nan_to_num(np.asarray(v, dtype=np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf)
            places = block * block_size + np.arange(block_size, dtype=np.int64)
            step = max(1, SIGNS // (j1 - j0))
            for a in range(0, block_size, step):
                np.add.at(sums, codes[at], x[:, a:a + step] @ signs(places[a:a + step], j0, j1, seed))

    blocks = df.select(row_col, F.col(block_col).cast("long").alias(block_col), F.col(values_col).cast("array<double>").alias(values_col))
    return _summed(blocks.mapInPandas(lambda it: _pieces(it, row_col, k, add), _partial_schema(df, row_col)), row_col, sizes)


def sign_sql(i: str, j: str, seed: int) -> str:
    """The same sign as SQL (DuckDB), for oracles."""
    return (f"CASE WHEN bit_count((({i} * {MULT_I} + {j} * {MULT_J} + {seed} * {MULT_SEED}) % {_MOD})::BIGINT) % 2 = 0 "
            f"THEN 1.0 ELSE -1.0 END")
