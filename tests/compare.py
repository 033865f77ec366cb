"""Run registered queries on Spark and their oracle SQL on DuckDB; compare
row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
sys.path.insert(0, __file__.rsplit("/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def digest(pdf: pd.DataFrame) -> str:
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for _, r in pdf.iterrows())
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def type_diff(sdf, rel) -> dict:
    """Columns whose Spark type maps to a different DuckDB type."""
    st = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st[c], dt.get(c)) for c in st if st[c] != dt.get(c) and not st[c].startswith(("ArrayType", "Struct"))}


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            out[name] = ("spark-error", repr(e)[:400])
            continue
        ts = time.time() - t0
        if name not in orc:
            out[name] = ("rows-only", len(s), round(ts, 2))
            continue
        try:
            rel = con.sql(orc[name])
            types = type_diff(sdf, rel)
            d = rel.df()
        except Exception as e:  # noqa: BLE001
            out[name] = ("sql-error", repr(e)[:400])
            continue
        ok_cols = sorted(s.columns) == sorted(d.columns)
        ok_rows = len(s) == len(d)
        ok_hash = ok_cols and digest(s) == digest(d)
        status = "OK" if ok_cols and ok_rows and ok_hash else "MISMATCH"
        if status == "OK" and types:
            status = "TYPE-MISMATCH"
        out[name] = (status, dict(rows=(len(s), len(d)), cols=ok_cols or (sorted(s.columns), sorted(d.columns)),
                                  hash=ok_hash, types=types or True, sec=round(ts, 2)))
    if verbose:
        for k, v in out.items():
            print(k, v)
    return out


if __name__ == "__main__":
    from curatio.session import get_session
    sp = get_session("local[8]", shuffle_partitions=8)
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    compare(sp, sf, sys.argv[2:] or None)
