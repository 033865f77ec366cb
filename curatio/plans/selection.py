"""Composed selection flows over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dialogs import default_pair_scores, final_score, turn_pairs
from ..operators.select import greedy_diverse
from ..sources.tables import table


def scored_dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> B1 pairs -> default pair scores -> D2 final score."""
    conv = table(spark, sf_dir, "conversations")
    return final_score(default_pair_scores(turn_pairs(conv)))


def scored_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scores aligned to vectors by id (conv_id = vec_id), inner."""
    emb = table(spark, sf_dir, "embeddings")
    return (scored_dialogs(spark, sf_dir)
            .join(emb.select(F.col("vec_id").alias("conv_id"), "embedding"), "conv_id"))


def greedy_selection(spark: SparkSession, sf_dir: str, tau: float = 0.2, data_size: int = 10,
                     batch_size: int = 1) -> DataFrame:
    """Flagship (I5): C1 -> D2 -> F2/F3 -> selected ids in selection order."""
    sel = greedy_diverse(scored_with_vectors(spark, sf_dir), tau=tau, data_size=data_size,
                         batch_size=batch_size, id_col="conv_id", score_col="final_score")
    return sel.select("conv_id", "final_score", F.col("sel_rank").cast("long").alias("sel_rank"))
