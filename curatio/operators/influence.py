"""Gradient-influence scoring.

Score of a training row = max over validation subtasks of the mean over
the subtask's rows of ``sum_c w_c * <train_c, valid_c>``.  The mean over
validation rows commutes with the dot product and the checkpoint sum, so
validation vectors are first averaged to one vector per (checkpoint,
subtask): N_train x N_subtasks products instead of N_train x N_valid.

A training row's checkpoint vectors are laid end to end, the subtask means scaled
by the checkpoint weights likewise, and one matrix product scores a block of rows
against a piece of the means (``PIECE_BYTES`` each): no join on the checkpoint, no
explode of components, no broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes of a block of rows or a piece of means, and of sums that a task keeps before it passes them on
PIECE_BYTES = 32 << 20
#: checkpoints a model may have
MAX_CHECKPOINTS = 4096


def normalised_weights(weights: DataFrame, ckpt_col: str = "ckpt", w_col: str = "weight") -> DataFrame:
    """Checkpoint weights scaled to sum 1 (the total is a scalar subquery)."""
    tot = weights.agg(F.sum(w_col)).scalar()
    return weights.select(ckpt_col, (F.col(w_col) / tot).alias(w_col))


def subtask_means(valid: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Per (ckpt, subtask) component-wise mean of the validation vectors.

    A task adds up whole vectors and passes on one row per (ckpt, subtask), more often if its sums take
    over ``PIECE_BYTES``; so a subtask with millions of rows meets as one row a task."""
    rows = valid.select("ckpt", "subtask", F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("ckpt", "subtask"))

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v.tolist(), n) for k, (v, n) in sums.items()], columns=["ckpt", "subtask", "v", "n"])
            sums.clear()
            return out

        for pdf in frames:
            for key, part in pdf.groupby(["ckpt", "subtask"], dropna=False, sort=False):
                total, n = sums.get(key, (0.0, 0))
                sums[key] = (total + np.stack(part["v"].values).sum(0), n + len(part))
            if sum(v.nbytes for v, _ in sums.values()) > PIECE_BYTES:
                yield flush()
        if sums:
            yield flush()

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(pdf["v"].values).sum(0) / pdf["n"].sum()
        return pdf[["ckpt", "subtask"]].head(1).assign(mean_vec=[total.tolist()])

    partial = rows.mapInPandas(add, f"{kinds}, v array<double>, n long")
    return partial.groupBy("ckpt", "subtask").applyInPandas(mean, f"{kinds}, mean_vec array<double>")


def _best_of(scale: dict):
    """Kernel of one (block of rows, piece of means): the largest score of each row over the piece's subtasks
    that share a checkpoint with it."""
    number = {c: i for i, c in enumerate(scale)}

    def laid_out(keys: pd.Series, ckpt: pd.Series, v: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different keys, their vectors end to end by checkpoint, and which checkpoints they have."""
        place, names = pd.factorize(keys, use_na_sentinel=False)
        at, x = np.array([number[c] for c in ckpt], np.int64), np.stack(v.values)
        out, has = np.zeros((len(names), len(number), x.shape[1])), np.zeros((len(names), len(number)), bool)
        np.add.at(out, (place, at), x)
        has[place, at] = True
        return np.array(names.tolist(), dtype=object), out, has

    def run(rows: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(means):
            return pd.DataFrame({"row": np.zeros(0, object), "influence": np.zeros(0)})
        names, x, has = laid_out(rows["row"], rows["ckpt"], rows["v"])
        _, m, held = laid_out(means["subtask"], means["ckpt"], means["mean_vec"])
        m *= np.array(list(scale.values()))[None, :, None]
        score = np.where(has.astype(np.int32) @ held.T.astype(np.int32) > 0, x.reshape(len(x), -1) @ m.reshape(len(m), -1).T, -np.inf)
        best = score.max(1)
        return pd.DataFrame({"row": names, "influence": best})[np.isfinite(best)]
    return run


def influence_scores(train: DataFrame, valid: DataFrame, weights: DataFrame,
                     row_col: str = "row_id", vec_col: str = "vec") -> DataFrame:
    """``train(ckpt, row_id, vec)``, ``valid(ckpt, subtask, vec)``,
    ``weights(ckpt, weight)`` (normalised here) -> ``(row_id, influence)``.

    Rows are dealt by id to blocks and means by subtask to pieces, both of about ``PIECE_BYTES``; every block
    meets every piece, and only counts and the weights reach the driver.
    A (row, subtask) score sums over the checkpoints both have and a weight names; rows that share none with
    any subtask have no score.  Rows of one (row, checkpoint) add up; NULL vectors are left out."""
    scale: dict = {}
    for r in normalised_weights(weights).limit(MAX_CHECKPOINTS + 1).collect():
        scale[r["ckpt"]] = scale.get(r["ckpt"], 0.0) + r["weight"]
    if len(scale) > MAX_CHECKPOINTS:
        raise ValueError(f"over {MAX_CHECKPOINTS} checkpoints")
    known = F.col("ckpt").isin(list(scale))
    size = valid.agg(F.approx_count_distinct("subtask").alias("n"), F.max(F.size(vec_col)).alias("d")).first()
    kind = train.schema[row_col].dataType.simpleString()
    bytes_ = 8 * (size["d"] or 1)
    pieces = max(1, -(-size["n"] * len(scale) * bytes_ // PIECE_BYTES))
    blocks = max(1, -(-train.count() * bytes_ // PIECE_BYTES))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    rows = train.where(F.col(vec_col).isNotNull() & known).select(F.col(row_col).alias("row"), "ckpt", F.col(vec_col).cast("array<double>").alias("v"))
    means = subtask_means(valid, vec_col).where(known)
    left = dealt(rows, "row", "block", blocks, "piece", pieces).groupBy("block", "piece")
    right = dealt(means, "subtask", "piece", pieces, "block", blocks).groupBy("block", "piece")
    best = left.cogroup(right).applyInPandas(_best_of(scale), f"row {kind}, influence double")
    best = best.groupBy("row").agg(F.max("influence").alias("influence")) if pieces > 1 else best
    return best.withColumnRenamed("row", row_col)


def checkpoint_vectors(emb: DataFrame, id_col: str, vec_col: str, n_ckpt: int) -> DataFrame:
    """Stand-in per-checkpoint vectors derived from one embedding table:
    checkpoint ``c`` sees the vector rotated left by ``c`` components."""
    n = F.size(vec_col)
    rows = emb.select(id_col, vec_col, "label", F.explode(F.sequence(F.lit(0), F.lit(n_ckpt - 1))).alias("ckpt"))
    rot = F.concat(F.slice(vec_col, F.col("ckpt") + 1, n - F.col("ckpt")),
                   F.slice(vec_col, F.lit(1), F.col("ckpt")))
    return rows.select(F.col(id_col).alias("row_id"), "label", "ckpt",
                       F.transform(rot, lambda x: x.cast("double")).alias("vec"))
