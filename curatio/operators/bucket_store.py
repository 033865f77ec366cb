"""Tables that are written in place: rows filed by key hash, only touched buckets rewritten.

The rows lie in one folder per bucket of the keys' hash.  An insert appends files to
the buckets of its new rows; an update or delete rewrites the buckets that hold a
matching row, all others keep their files.  Which buckets those are follows from the
keys where the condition names all of them, else from a scan of the condition's
columns alone; their list (at most ``buckets`` numbers) is all that reaches the driver.

A rewrite is written whole beside the table first and then takes the buckets' place by
dynamic partition overwrite.  A driver lost in between leaves the finished copy, which
the next ``open`` puts in place; an unfinished one is dropped and the table is as
before.  Inserts may simply be repeated.  One writer at a time; a DataFrame from
``rows()`` reads the files of its moment, so ask again after a write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

from . import store

BUCKET, LIVE = "store_bucket", "store_live"


def _delete_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class BucketStore:
    """A table under ``path`` filed by ``keys``; see ``create`` and ``open``.

    Every bucket that was ever rewritten holds one row that is not live, so that a
    bucket whose last row goes is overwritten like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, keys, buckets: int = 64) -> BucketStore:
        """A new store with the rows of ``df``, as they are (repeated keys stay)."""
        taken = {BUCKET, LIVE} & set(df.columns)
        if taken or not set(keys) <= set(df.columns):
            raise ValueError(f"columns {sorted(taken)} are the store's own" if taken else "keys must be columns of the table")
        made = cls(df.sparkSession, path, df.schema, list(keys), int(buckets))
        made._filed(df).write.partitionBy(BUCKET).parquet(f"{made.path}/rows")
        layout = made.spark.createDataFrame([(made.keys, made.buckets, df.schema.json())], "keys array<string>, buckets int, layout string")
        layout.coalesce(1).write.parquet(f"{made.path}/layout")
        return made

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> BucketStore:
        """The store under ``path``; a rewrite that was cut off is finished or dropped."""
        import json

        at = spark.read.parquet(f"{path.rstrip('/')}/layout").first()
        made = cls(spark, path, StructType.fromJson(json.loads(at["layout"])), list(at["keys"]), at["buckets"])
        if _exists(spark, f"{made.path}/pending/_SUCCESS"):
            made._put_in_place()
        else:
            _delete_folder(spark, f"{made.path}/pending")
        return made

    def rows(self) -> DataFrame:
        """The table."""
        return self._read("rows").where(LIVE).select(*self.schema.names)

    def insert(self, batch: DataFrame) -> None:
        """Appends the rows of ``batch``, one per keys, whose keys (NULL matches NULL)
        no row has.  Reads the batch's buckets; no file of the table changes."""
        known = self._in(self._buckets(batch, self.keys)).select(*self.schema.names)
        new = store.absent_rows(known, batch, self.keys)
        self._filed(self._typed(new)).write.mode("append").partitionBy(BUCKET).parquet(f"{self.path}/rows")

    def delete(self, victims: DataFrame, on, first_only: bool = False, id_col: str = "id") -> list[int]:
        """Removes the rows that match ``victims`` on ``on``, with ``first_only`` the
        lowest ``id_col`` of each match.  Returns the buckets rewritten."""
        on = list(on)
        touched = self._touched(victims, on)
        part = self._in(touched).select(*self.schema.names)
        left = store.delete_by(part, self._typed_keys(victims, on), on, first_only, id_col)
        return self._rewrite(touched, left)

    def update(self, updates: DataFrame, id_col: str = "id", time_col: str | None = None, order_col: str | None = None) -> list[int]:
        """Partial update by id as in ``store.update_by_id``; a row whose keys change moves
        to the bucket of its new keys.  Returns the buckets rewritten."""
        touched = self._touched(updates, [id_col])
        new = store.update_by_id(self._in(touched).select(*self.schema.names), updates, id_col, time_col, order_col)
        if set(updates.columns) & set(self.keys) - {id_col}:
            more = sorted(set(self._buckets(new, self.keys)) - set(touched))
            new, touched = new.unionByName(self._in(more).select(*self.schema.names)), sorted({*touched, *more})
        return self._rewrite(touched, new)

    # ------------------------------------------------------------------ buckets

    def _typed(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def _typed_keys(self, df: DataFrame, on: list[str]) -> DataFrame:
        """The columns ``on`` in the table's types: a hash depends on the type."""
        return df.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in on])

    def _same(self, part: DataFrame, on: list[str]) -> Column:
        cond = F.lit(True)
        for k in on:
            cond &= part[k].eqNullSafe(F.col(f"v.{k}"))
        return cond

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _filed(self, df: DataFrame) -> DataFrame:
        """Rows with their bucket, brought together by it (AQE splits a bucket that is large)."""
        return df.withColumn(LIVE, F.lit(True)).withColumn(BUCKET, self._bucket()).hint("rebalance", F.col(BUCKET))

    def _read(self, folder: str) -> DataFrame:
        schema = StructType([*self.schema.fields]).add(LIVE, BooleanType()).add(BUCKET, IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _in(self, buckets: list[int]) -> DataFrame:
        return self._read("rows").where(F.col(BUCKET).isin(buckets)).where(LIVE)

    def _buckets(self, df: DataFrame, keys: list[str]) -> list[int]:
        """The buckets of the keys of ``df``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self._typed_keys(df, keys).select(self._bucket()).distinct().collect())

    def _touched(self, wanted: DataFrame, on: list[str]) -> list[int]:
        if set(self.keys) <= set(on):
            return self._buckets(wanted, self.keys)
        held = self._read("rows").where(LIVE).select(*on, BUCKET)
        hit = held.join(self._typed_keys(wanted, on).distinct().alias("v"), self._same(held, on), "left_semi")
        return sorted(r[0] for r in hit.select(BUCKET).distinct().collect())

    # ----------------------------------------------------------------- rewriting

    def _rewrite(self, touched: list[int], rows: DataFrame) -> list[int]:
        if not touched:
            return []
        marks = self.spark.range(1).select(F.explode(F.array(*[F.lit(b) for b in touched])).alias(BUCKET)).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(False).alias(LIVE), BUCKET)
        whole = self._filed(self._typed(rows)).unionByName(marks)
        whole.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/pending")
        self._put_in_place()
        return touched

    def _put_in_place(self) -> None:
        filed = self._read("pending").hint("rebalance", F.col(BUCKET))
        (filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(f"{self.path}/rows"))
        _delete_folder(self.spark, f"{self.path}/pending")
