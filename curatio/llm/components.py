"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for every id on an edge (a, b).

    Large-star joins each node's larger neighbours to its smallest one,
    small-star its smaller neighbours; repeated until nothing changes, which
    leaves one star per component.  Every step is a narrow aggregate and a join
    on two longs, written out once; no component is ever gathered."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = large.where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(low, "u")
        e = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                        .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
