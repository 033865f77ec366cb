"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes and (but for the last) returns the columns of ``documents``;
``run`` writes what a stage returns as Parquet and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatio.llm import minhash, packing, pii, quality, suffix
from curatio.llm.common import materialize
from curatio.session import ship_package
from curatio.sources.tables import table

TOKENIZER = "byte_bpe_50k.json"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text a stage has changed; a null text has none."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.quality_rules(docs, table(spark, sf_dir, "labels"), carry=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group; of rows that share a doc_id one, rows without one all."""
    kept = minhash.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("_row", first).where("_row = 1").select(*docs.columns)
    return one.unionByName(docs.where("doc_id IS NULL"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document holds."""
    return _counted(suffix.without_earlier_copies(docs))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces (with their ids) and their places in sequences of 2048."""
    import public_tokenizers

    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(TOKENIZER), end_id=1))


STAGES = [("quality_rules", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeated_passages", passage_stage),
          ("personal_data", personal_data_stage), ("packing", packing_stage)]

#: the trees, the span classifier and the tokenizer have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
