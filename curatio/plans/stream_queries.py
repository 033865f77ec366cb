"""Registered queries of the streaming jobs: files arrive, the query is started again, the stored table is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.projection import project, sign_sql
from ..session import new_folder
from ..sources.tables import table
from ..streaming import ingest as SI
from .registry import query

SEEN = "array<struct<role: string, content: string>>"


@query("stream_dialogs", """
WITH d AS (SELECT conv_id, count(*)::INT AS turn, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS m
           FROM conversations GROUP BY conv_id),
o AS (SELECT 1::INT AS turn, role || chr(10) || text || chr(10) AS m FROM conversations)
SELECT turn, md5(m) AS messages_md5 FROM (SELECT turn, m FROM d UNION SELECT turn, m FROM o)""")
def stream_dialogs_q(spark, sf):
    """All dialogues arrive as files, then all of them again with every message as a dialogue of
    its own; the stream, stopped and started in between, stores each different dialogue once."""
    c = table(spark, sf, "conversations")
    whole = (c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
             .select(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("message"),
                     F.size("m").alias("turn")))
    single = c.select(F.array(F.struct("role", F.col("text").alias("content"))).alias("message"), F.lit(1).alias("turn"))
    root = new_folder(spark)
    for arrival in (whole, whole.unionByName(single)):
        arrival.write.mode("append").json(f"{root}/in")
        SI.dialog_ingest(spark, f"{root}/in", f"{root}/table", f"{root}/state",
                         state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    m = F.from_json("message_json", SEEN)
    text = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("\n"), x["content"], F.lit("\n"))), "")
    return spark.read.parquet(f"{root}/table").select("turn", F.md5(text).alias("messages_md5"))


@query("stream_vectors", f"""
WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
j AS (SELECT unnest(range(4)) AS j)
SELECT vec_id, (vec_id // 160)::BIGINT AS chunk, j.j::BIGINT AS j,
       round(sum(x::DOUBLE * {sign_sql('i', 'j.j', 3)}) / 2, 4)::DOUBLE + 0.0 AS value
FROM e, j GROUP BY ALL""")
def stream_vectors_q(spark, sf):
    """Vectors arrive in two sets of files that overlap, the restarted stream projects and
    stores each id once, the chunks are merged."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    root = new_folder(spark)
    for arrival in (e.filter("vec_id % 2 = 0"), e):
        arrival.write.mode("append").parquet(f"{root}/in")
        SI.vector_stream(spark, f"{root}/in", "vec_id long, embedding array<float>", f"{root}/table", f"{root}/state",
                         compute=lambda b: project(b, "embedding", 4, seed=3, out_col="vec").drop("embedding"), id_col="vec_id",
                         state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    m = SI.merged_vectors(spark, f"{root}/table", "vec_id")
    return m.select("vec_id", "chunk", F.posexplode("vec").alias("j", "value")).select(
        "vec_id", "chunk", F.col("j").cast("long").alias("j"), (F.round("value", 4) + F.lit(0.0)).alias("value"))
