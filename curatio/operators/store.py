"""Template and dialogue tables: upsert, search, update, delete.

Every write is a set operation on whole DataFrames: a batch of new rows is
matched against the table with a null-safe anti join and appended, so a
batch of any size is one shuffle, never a row-at-a-time loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _null_safe_on(a: DataFrame, b: DataFrame, keys) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def absent_rows(table: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """Rows of ``batch``, one per ``keys``, whose keys match no row of
    ``table`` (NULL matches NULL), in the table's columns."""
    keys = list(keys)
    b = batch.dropDuplicates(keys)
    new = b.alias("b").join(table.alias("t"), _null_safe_on(b.alias("b"), table.alias("t"), keys), "left_anti")
    return new.select(*table.columns)


def insert_if_absent(table: DataFrame, batch: DataFrame, keys) -> DataFrame:
    """The table with the absent rows of ``batch`` after it; matching
    rows are left as they are (the reference's update branch rewrites the
    same values)."""
    return table.unionByName(absent_rows(table, batch, keys))


def delete_by(table: DataFrame, victims: DataFrame, keys, first_only: bool = False,
              id_col: str = "id") -> DataFrame:
    """Remove rows matching ``victims`` on ``keys`` (NULL matches NULL); with
    ``first_only`` only the lowest ``id_col`` per match is removed.  Absent keys are fine."""
    keys = list(keys)
    t, v = table.alias("t"), victims.select(*keys).distinct().alias("v")
    match = _null_safe_on(t, v, keys)
    if first_only:
        first = t.join(v, match, "left_semi").groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(id_col)
        return table.join(first, id_col, "left_anti")
    return t.join(v, match, "left_anti")


def update_by_id(table: DataFrame, updates: DataFrame, id_col: str = "id",
                 time_col: str | None = "update_time", order_col: str | None = None) -> DataFrame:
    """Partial update by id; columns of ``updates`` unknown to the
    table are ignored, NULL in ``updates`` means "leave as is".

    Several updates of one id become one: by column, the last non-NULL value in
    ``order_col`` order (default: the greatest value, so the result never
    depends on row order).  Ids the table lacks: see ``missing_ids``."""
    cols = [c for c in updates.columns if c in table.columns and c not in (id_col, order_col)]
    by = F.col(order_col) if order_col else None
    last = [(F.max_by(c, F.when(F.col(c).isNotNull(), by)) if order_col else F.max(c)).alias(f"_new_{c}") for c in cols]
    u = updates.groupBy(id_col).agg(F.lit(True).alias("_hit"), *last)
    j = table.join(u, id_col, "left")
    out = []
    for c in table.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        elif time_col and c == time_col:
            out.append(F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def missing_ids(table: DataFrame, updates: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids of ``updates`` that no row of the table has."""
    return updates.select(id_col).distinct().join(table.select(id_col), id_col, "left_anti")


def keyword_search(df: DataFrame, col: str, keywords, escape: bool = False) -> DataFrame:
    """Case-insensitive substring match of any keyword.  ``%`` and
    ``_`` inside a keyword stay wildcards (as in the reference) unless
    ``escape`` is set."""
    def pat(k: str) -> str:
        if escape:
            k = k.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        return f"%{k}%"
    cond = reduce(lambda a, b: a | b, [F.col(col).ilike(pat(k)) for k in keywords])
    return df.filter(cond)


def first_match(df: DataFrame, col: str, keyword: str, id_col: str = "id") -> DataFrame:
    """B13 for SFT / raw tables: only the lowest-id hit (a top-1 report)."""
    return keyword_search(df, col, [keyword]).orderBy(id_col).limit(1)


def exists_ci(df: DataFrame, probes: DataFrame, col: str) -> DataFrame:
    """B14 batch form: probes whose text equals some row case-insensitively."""
    t = df.select(F.lower(F.col(col)).alias("_k")).distinct()
    return probes.join(t, F.lower(probes[col]) == t["_k"], "left_semi")


def exists_like(df: DataFrame, col: str, text: str) -> DataFrame:
    """One row ``(found)``: whether some row matches ``text`` case-insensitively,
    with ``%`` and ``_`` in ``text`` as wildcards."""
    return df.agg(F.coalesce(F.bool_or(F.col(col).ilike(text)), F.lit(False)).alias("found"))


def with_audit(df: DataFrame, user: str | None = None, id_col: str = "id") -> DataFrame:
    """Audit columns on new rows: ``create_time``/``update_time`` now
    (UTC session time zone), ``create_by``/``update_by``; an ``id`` is added
    when missing (unique, not dense)."""
    out = df
    if id_col not in out.columns:
        out = out.withColumn(id_col, F.monotonically_increasing_id())
    now = F.current_timestamp()
    return (out.withColumn("create_time", now).withColumn("update_time", now)
            .withColumn("create_by", F.lit(user).cast("string")).withColumn("update_by", F.lit(user).cast("string")))
