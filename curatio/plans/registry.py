"""Registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracles.

Every query reads the supplied tables in full.  Oracle SQL runs on DuckDB
with the tables pre-registered as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name!r}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# SQL fragments shared by several oracles --------------------------------------

SQL_POSITIONS = """
shifted AS (SELECT conv_id, 1 AS s FROM conversations WHERE turn = 0 AND role NOT IN ('user', 'human')),
pos AS (SELECT c.conv_id, c.turn - coalesce(s.s, 0) AS pos, c.role, c.text
        FROM conversations c LEFT JOIN shifted s USING (conv_id)
        WHERE c.turn - coalesce(s.s, 0) >= 0)"""

SQL_PAIRS = SQL_POSITIONS + """,
pairs AS (SELECT i.conv_id, (i.pos // 2)::BIGINT AS pair_idx, i.text AS instruction,
                 coalesce(r.text, '') AS response
          FROM pos i LEFT JOIN pos r ON r.conv_id = i.conv_id AND r.pos = i.pos + 1
          WHERE i.pos % 2 = 0)"""

SQL_BUCKET = "least(6, greatest(1, ceil(len(regexp_extract_all({x}, '\\S+')) / 20.0)))::DOUBLE"

SQL_SCORED = SQL_PAIRS + f""",
sc AS (SELECT conv_id, sum({SQL_BUCKET.format(x='instruction')} * {SQL_BUCKET.format(x='response')})::DOUBLE AS final_score
       FROM pairs GROUP BY conv_id)"""


def greedy_sql(tau: float, data_size: int, batch_size: int) -> str:
    """Sequential scan as a recursive CTE over batches (row 0 alone)."""
    return "WITH RECURSIVE " + SQL_SCORED + f""",
ranked AS (SELECT conv_id, final_score, embedding::DOUBLE[] AS e,
                  row_number() OVER (ORDER BY final_score DESC, conv_id) - 1 AS rk
           FROM sc JOIN embeddings ON conv_id = vec_id),
rb AS (SELECT *, CASE WHEN rk = 0 THEN 0 ELSE 1 + (rk - 1) // {batch_size} END AS batch FROM ranked),
g(batch, kept) AS (
  SELECT 0::BIGINT, [0::BIGINT]
  UNION ALL
  SELECT g.batch + 1,
         list_concat(g.kept, coalesce((
           SELECT list(a.rk ORDER BY a.rk) FROM rb a
           WHERE a.batch = g.batch + 1
             AND NOT EXISTS (SELECT 1 FROM rb b WHERE list_contains(g.kept, b.rk)
                             AND list_cosine_similarity(a.e, b.e) > {tau})
             AND NOT EXISTS (SELECT 1 FROM rb c WHERE c.batch = a.batch AND c.rk < a.rk
                             AND list_cosine_similarity(a.e, c.e) > {tau})), []::BIGINT[]))
  FROM g
  WHERE g.batch < (SELECT max(batch) FROM rb)
    AND ({data_size} < 0 OR len(g.kept) < {data_size})
),
fin AS (SELECT kept FROM g ORDER BY batch DESC LIMIT 1),
sel AS (SELECT unnest(kept) AS rk, generate_subscripts(kept, 1) - 1 AS sel_rank FROM fin)
SELECT r.conv_id, r.final_score, sel.sel_rank::BIGINT AS sel_rank
FROM sel JOIN ranked r USING (rk)
WHERE {data_size} < 0 OR sel.sel_rank < {data_size}"""
