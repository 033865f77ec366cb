"""Readers and writers with explicit schemas.

Every reader takes a schema (FAILFAST by default) so a bad record is an
error at read time, as in the reference; writers are plain DataFrame
writes (Parquet/JSON/CSV) partitioned where the reference used one file per
group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .json_split import read_array, split_records

SHAREGPT = "id long, conversations array<struct<`from`: string, value: string>>"
TRIPLET = "instruction string, input string, output string"
EMBEDDING = "idx long, embedding array<float>"
PREFERENCE = ("prompt string, messages array<struct<role: string, content: string>>, "
              "chosen array<struct<role: string, content: string>>, "
              "rejected array<struct<role: string, content: string>>, split string")


def _paths(p):
    return [p] if isinstance(p, str) else list(p)


def is_json_array(spark: SparkSession, path: str) -> bool:
    """First non-space character of a file is ``[`` (read up to its first closing brace)."""
    first = (spark.read.option("lineSep", "}").text(path).select(F.regexp_replace("value", r"^[\uFEFF\s]+", "").alias("v"))
             .filter(F.col("v") != "").limit(1).collect())
    return bool(first) and first[0]["v"].startswith("[")


#: a JSON array up to this size is one task's work; a larger one is cut by many (both read the same records)
ONE_TASK_BYTES = 256 << 20


def _read_arrays(spark: SparkSession, paths: list[str], schema: str, mode: str) -> DataFrame:
    large = [r["path"] for r in spark.read.format("binaryFile").load(paths).select("path", "length")
             .filter(F.col("length") > ONE_TASK_BYTES).select("path").collect()]
    if not large:
        return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(paths)
    return read_array(spark, paths, schema, mode)


def read_json_records(spark: SparkSession, path, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """A1/A2/A3: one JSON array per file, cut into records by many tasks where
    one is larger than ``ONE_TASK_BYTES``, or JSON lines; a list of paths is read as one set (UNION ALL, G1), each path
    by its own kind."""
    kinds: dict[bool, list[str]] = {}
    for p in _paths(path):
        kinds.setdefault(is_json_array(spark, p), []).append(p)
    frames = [_read_arrays(spark, some, schema, mode) if array else spark.read.schema(schema).option("mode", mode).json(some)
              for array, some in sorted(kinds.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_dialogues(spark: SparkSession, path) -> DataFrame:
    """A1: ShareGPT dialogues."""
    return read_json_records(spark, path, SHAREGPT)


def sharegpt_to_long(df: DataFrame, id_col: str = "id") -> DataFrame:
    """ShareGPT array form -> long ``(conv_id, turn, role, text)``."""
    role = F.when(F.col("m.from").isin("human", "user"), F.lit("user")).when(
        F.col("m.from").isin("gpt", "assistant"), F.lit("assistant")).otherwise(F.col("m.from"))
    return (df.select(F.col(id_col).alias("conv_id"), F.posexplode("conversations").alias("turn", "m"))
            .select("conv_id", F.col("turn").cast("long"), role.alias("role"), F.col("m.value").alias("text")))


def read_triplets(spark: SparkSession, path) -> DataFrame:
    """A2: instruction triplets; a missing ``input`` is NULL."""
    return read_json_records(spark, path, TRIPLET)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """``(idx, embedding)`` parquet; the id is required (no positional ids)."""
    df = spark.read.parquet(path)
    if "idx" not in df.columns:
        raise ValueError("embedding table needs an explicit idx column")
    return df


def write_embeddings(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by idx across files (range partitioned, sorted within)."""
    n = partitions or df.rdd.getNumPartitions()
    df.repartitionByRange(n, "idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def gather_in_order(records: DataFrame, selected: DataFrame, id_col: str, rank_col: str = "sel_rank") -> DataFrame:
    """Records of the selected ids in selection order (semi join, then
    a global sort on the rank)."""
    return records.join(selected.select(id_col, rank_col), id_col).orderBy(rank_col)


def write_selected(records: DataFrame, selected: DataFrame, path: str, id_col: str,
                   rank_col: str = "sel_rank") -> None:
    """Selected records as JSON lines in selection order."""
    gather_in_order(records, selected, id_col, rank_col).write.mode("overwrite").json(path)


def write_any(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write; types JSON cannot hold are written as strings."""
    if fmt == "json":
        simple = ("string", "bigint", "int", "double", "float", "boolean", "array", "struct", "map")
        df = df.select(*[F.col(c) if t.split("<")[0] in simple else F.col(c).cast("string").alias(c)
                         for c, t in df.dtypes])
    df.write.mode(mode).format(fmt).save(path)


def ensure_table(spark: SparkSession, name: str, df: DataFrame, recreate: bool = False) -> DataFrame:
    """Create the table if missing (``ignore``), or drop and
    recreate it; returns ``spark.table(name)``."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        df.write.mode("overwrite").saveAsTable(name)
    else:
        df.write.mode("ignore").saveAsTable(name)
    return spark.table(name)


def export_answers(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per (domain, task, class, model type) dataset."""
    (df.write.mode("overwrite").partitionBy("domain_name", "task_name", "cls_name", "model_type")
     .format(fmt).save(path))


def write_vectors(df: DataFrame, path: str) -> None:
    """A21 layout: ``ckpt=<c>/dataset=<name>/`` partitions."""
    df.write.mode("append").partitionBy("ckpt", "dataset").parquet(path)


def read_vectors(spark: SparkSession, path: str, ckpts=None, datasets=None) -> DataFrame:
    """Partition pruning on ``ckpt`` and ``dataset``."""
    df = spark.read.parquet(path)
    if ckpts is not None:
        df = df.filter(F.col("ckpt").isin(list(ckpts)))
    if datasets is not None:
        df = df.filter(F.col("dataset").isin(list(datasets)))
    return df


def read_preferences(spark: SparkSession, path, split: str | None = None) -> DataFrame:
    """Preference data from local JSON or Parquet, filtered on split."""
    p = _paths(path)
    df = spark.read.parquet(*p) if p[0].endswith(".parquet") else read_json_records(spark, p, PREFERENCE)
    return df.filter(F.col("split") == split) if split else df


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """``{category: [instruction, ...]}`` file -> long
    ``(category, instruction, position)`` (file order kept for C10: place of
    the category in the file, then of the instruction in it).  The file is cut
    at its categories; one category is one record."""
    one = F.from_json(F.concat(F.lit("{"), "record", F.lit("}")), "map<string,array<string>>", {"mode": "FAILFAST"})
    return (split_records(spark, path, "]").select("pos", F.explode(one).alias("category", "items"))
            .select("category", "pos", F.posexplode("items").alias("item_pos", "instruction"))
            .select("category", "instruction", F.struct("pos", "item_pos").alias("position")))


def invert_category_map(cm: DataFrame) -> DataFrame:
    """Instruction -> category, last by position wins; repeats within a
    category are counted (``dup_in_category``)."""
    return cm.groupBy("instruction").agg(
        F.max_by("category", "position").alias("category"),
        (F.count(F.lit(1)) - F.count_distinct("category")).alias("dup_in_category"))
