"""JSON documents of any size cut into their records by many tasks.

One array (or one object of arrays) in a file has no line to split at.  The
text reader splits it at every closing bracket instead, inside byte ranges it
plans itself.  Whether a bracket closes a record depends on all text before
it, through two things only: whether a string is open, and the depth.  Each
range reports how it changes both, from either string state; running sums
over the ranges of a file give every range its first state; then each range
cuts its own records, and the pieces of a record that crosses ranges are put
together by range order.  Text is scanned twice and only crossing records are
shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1
_ESCAPE = re.compile(r"\\.", re.S)      # outside strings JSON has no backslash, and none stands before a bracket


def scan(values: list[str], close: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What consecutive pieces change, each with its closing bracket: quotes so far, and the depth
    so far (from 0) if the first starts outside a string, and if it starts inside one."""
    text = (close.join(values) + close)
    if "\\" in text:
        text = _ESCAPE.sub("__", text)
    raw = np.frombuffer(text.encode(), np.uint8)
    quotes = np.cumsum(raw == ord('"'), dtype=np.int64)
    step = _STEP[raw]
    ends = np.flatnonzero(raw == ord(close))
    if len(ends) != len(values):
        raise ValueError("a backslash before a bracket: no JSON")
    inside = (quotes & 1).astype(bool)
    return quotes[ends], np.cumsum(np.where(inside, 0, step))[ends], np.cumsum(np.where(inside, step, 0))[ends]


def pieces(spark: SparkSession, path, close: str) -> DataFrame:
    """``path, start, value``: text up to each closing bracket, with the byte range it was read in."""
    return (spark.read.option("lineSep", close).text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"))


def _ranges(batches):
    """Runs of rows of one range, in order: (path, start, values)."""
    for b in batches:
        names = b.column("path").dictionary_encode()
        code, starts = names.indices.to_numpy(zero_copy_only=False), b.column("start").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if to > at:
                yield names.dictionary[code[at]].as_py(), int(starts[at]), b.column("value").slice(at, to - at).to_pylist()


def _effects(close: str):
    def run(batches):
        """One row a range: its quotes and changes of depth (a range is never spread over tasks)."""
        out: dict = {}
        for path, start, values in _ranges(batches):
            flip, d = out.get((path, start), (0, (0, 0)))
            quotes, *depth = scan(values, close)
            d = tuple(int(d[s] + depth[(s + flip) % 2][-1]) for s in (0, 1))
            out[path, start] = int(flip + quotes[-1]) % 2, d
        if out:
            rows = [(*k, flip, *d) for k, (flip, d) in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "start", "flip", "from_out", "from_in"])
    return run


def _first_states(text: DataFrame, close: str) -> dict[tuple[str, int], tuple[int, int]]:
    """(path, start) -> (string open, depth) before each range: one row a byte range of the reader."""
    e = text.mapInArrow(_effects(close), "path string, start long, flip long, from_out long, from_in long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("open", F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2)
    e = e.withColumn("d", F.when(F.col("open") == 1, F.col("from_in")).otherwise(F.col("from_out")))
    e = e.withColumn("depth", F.coalesce(F.sum("d").over(before), F.lit(0)))
    rows = e.select("path", "start", "open", "depth", ((F.col("open") + F.col("flip")) % 2).alias("left"),
                    (F.col("depth") + F.col("d")).alias("end")).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        last[r["path"]] = r["left"], r["end"]
    for p, end in last.items():          # the outer bracket and the one the reader did not meet
        if end != (0, -1):
            raise ValueError(f"{p} is cut short or no JSON")
    return {(r["path"], r["start"]): (r["open"], r["depth"]) for r in rows}


def split_records(spark: SparkSession, path, close: str = "}") -> DataFrame:
    """``path, pos, record``: the texts at depth 1 that end in ``close``, with what stands between them and the one before.

    ``close`` is ``}`` for an array of objects and ``]`` for an object of
    arrays.  ``pos`` grows along a file.  Text other than separators that is
    left at the end (a cut file, a record of another kind) is an error.
    """
    text = pieces(spark, path, close)
    states = _first_states(text, close)
    first_of = {}
    for p, s in states:
        first_of[p] = min(s, first_of.get(p, s))
    outer = {"}": "[", "]": "{"}[close]

    def cut(batches):
        schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("record", pa.string()), ("kind", pa.int32())])
        rows: list[tuple] = []
        size = 0
        now = None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for path, start, values in _ranges(batches):
            if now is None or now[0] != (path, start):
                if now is not None and now[3]:
                    rows.append((now[0][0], now[0][1] + now[2], "".join(now[3]), 2))
                open_, depth = states[path, start]
                now = [(path, start), [open_, depth], 0, [], False, 0]    # key, state, place, text so far, a record has ended, next piece
            state, held = now[1], now[3]
            if start == first_of[path] and now[2] == 0:
                lead = values[0].lstrip("\ufeff \t\r\n")
                if lead[:1] != outer:
                    raise ValueError(f"{path} does not begin with {outer}")
            quotes, *depths = scan(values, close)
            open_, depth = (state[0] + quotes) % 2, state[1] + depths[state[0]]
            state[:] = int(open_[-1]), int(depth[-1])
            # a record ends at depth 1; the last piece of a file has no bracket of its own, the outer one closed before it
            for k in np.flatnonzero((open_ == 0) & ((depth == 1) | (depth < 0))).tolist() + [len(values)]:
                at = now[5]
                some = values[at:k + 1]
                if start == first_of[path] and now[2] == 0 and some:
                    some = [values[0].lstrip("\ufeff \t\r\n")[1:], *some[1:]]
                now[2] += len(some)
                if k == len(values):
                    held.extend(v + close for v in some)
                    now[5] = 0
                    break
                over = depth[k] < 0
                held.append(close.join(some) + ("" if over else close))
                rows.append((path, start + now[2], "".join(held), 2 if over else 0 if now[4] else 1))
                size += len(rows[-1][2])
                held.clear()
                now[4], now[5] = True, k + 1
                if len(rows) >= 10_000 or size > 4 << 20:
                    yield batch()
                    rows, size = [], 0
        if now is not None and now[3]:
            rows.append((now[0][0], now[0][1] + now[2], "".join(now[3]), 2))
        if rows:
            yield batch()

    # kind 0: whole records; 1: the end of a range's first record; 2: what a range leaves open
    rows = text.mapInArrow(cut, "path string, pos long, record string, kind int")
    # record is null where a filter drops the row: Spark may evaluate a caller's parse before the filters here
    whole = rows.filter("kind = 0").select("path", "pos", F.when(F.col("kind") == 0, F.col("record")).alias("record"))
    parts = rows.filter("kind > 0")
    ended = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("g", F.coalesce(F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(ended), F.lit(0)))
    joined = parts.groupBy("path", "g").agg(
        F.max("pos").alias("pos"), F.max(F.when(F.col("kind") == 1, 1)).alias("ended"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda x: x["record"]), "").alias("record"))
    end = {"}": r"^\s*(\]\s*)?$", "]": r"^\s*(\}\s*)?$"}[close]
    joined = joined.filter(F.col("ended").isNotNull() | _fails(~F.col("record").rlike(end), "path"))
    joined = joined.select("path", "pos", F.when(F.col("ended") == 1, F.col("record")).alias("record"))
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", r"^[\s,]+", ""))


def _fails(bad, path: str):
    """False, or an error that names the file."""
    return F.when(bad, F.raise_error(F.concat(F.lit("text that is no whole record at the end of "), F.col(path))).cast("boolean")).otherwise(F.lit(False))


def read_array(spark: SparkSession, path, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """The objects of one JSON array a file, read by many tasks."""
    rec = F.from_json("record", schema, {"mode": mode})
    return split_records(spark, path, "}").select(rec.alias("r")).select("r.*")
