"""Global positions without a single-partition window.

``row_number().over(Window.orderBy(...))`` moves every row to one task.
Here the data is range-partitioned and sorted by Spark, each partition
numbers its rows, and a per-partition offset (one row per partition, so
its size is bounded by the partition count) is broadcast back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_rank(df: DataFrame, order_cols, rank_col: str = "rk") -> DataFrame:
    """0-based dense position of every row in ``order_cols`` order.

    ``order_cols`` must define a total order (end it with a unique key).  The
    sorted rows are written out once, with their partition and place, so the
    offsets and the numbered rows come from the same files whatever Spark
    plans later.  Every column of ``df`` is written: pass the id and the sort
    keys alone and join the rest back (``rank_ids``)."""
    s = cut_lineage(df.orderBy(*order_cols)
                    .withColumn("_pid", F.spark_partition_id())
                    .withColumn("_mid", F.monotonically_increasing_id()))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(rank_col, (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mid", "_off"))


def rank_ids(df: DataFrame, id_col: str, order_cols, rank_col: str = "rk") -> DataFrame:
    """``id_col`` and its position by rising ``order_cols`` (values, not sort orders), then id: only the id
    and the keys are written."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    named = df.select(F.col(id_col).alias("_id"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    ranked = global_rank(named, [F.col(f"_k{i}") for i in range(len(keys))] + [F.col("_id")], rank_col)
    return ranked.select(F.col("_id").alias(id_col), rank_col)


def global_prefix_sum(df: DataFrame, order_cols, value_col: str, out_col: str = "prefix") -> DataFrame:
    """Inclusive running sum of ``value_col`` in ``order_cols`` order over the
    whole table.  Range-partitioned sort; each range partition (bounded by
    the partitioner, whatever the key skew) sums locally, and per-partition
    totals (one row per partition) are broadcast back as offsets."""
    s = (df.orderBy(*order_cols)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)
    local = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_loc", F.sum(value_col).over(local))
    tot = s.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    return (s.join(F.broadcast(offs), "_pid")
            .withColumn(out_col, F.col("_off") + F.col("_loc"))
            .drop("_pid", "_mid", "_loc", "_off"))
