"""Helpers shared by the operators: lineage cuts, Arrow mapping, ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatio.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor re-reads files, nothing is computed twice,
    and later reads prune columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, **names: str) -> DataFrame:
    """The named columns under the operator's own names, whatever else the frame holds."""
    return df.select(*[df[c].alias(k) for k, c in names.items()])


def signed(x):
    """uint64 array as int64 (Spark's long)."""
    return x.view("int64")


def hex64(col) -> F.Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def range_starts(ids: DataFrame, column: str, parts: int) -> list[int]:
    """First ids of about ``parts`` even ranges of a frame's non-null ids; at most ``parts`` longs come to the driver."""
    dealt = ids.select(F.col(column).alias("id")).where("id IS NOT NULL").repartitionByRange(parts, "id")
    return sorted(r["start"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("id").alias("start")).collect())


def range_part(column: str, starts: list[int]) -> F.Column:
    """1-based number of the range an id lies in: a coarse count, then a fine one."""
    step = max(1, int(len(starts) ** 0.5))
    fine, coarse = F.array(*[F.lit(x).cast("bigint") for x in starts]), F.array(*[F.lit(x).cast("bigint") for x in starts[::step]])
    near = (F.size(F.filter(coarse, lambda x: x <= F.col(column))) - 1) * step
    return near + F.size(F.filter(F.slice(fine, near + 1, F.lit(step)), lambda x: x <= F.col(column)))
