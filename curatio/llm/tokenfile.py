"""Token-id files: documents in ascending id order, coded in checksummed blocks (operator 5).

Ids are cut into ranges; each range is one partition, sorted by id, that
encodes its texts and writes frames.  A frame holds whole documents (a
directory of their ids and token counts) and the range-coder blocks of their
ids, up to ``LANES`` blocks unless one document is longer.  Frames need nothing
outside themselves to be read, so any of them can be read or read again alone.

Defined cases: a null or empty text is its end id alone; documents without an
id come last, in the order of a hash of their text; rows that share an id follow each other in the same
order; ids over 65,535 are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, range_part, range_starts, shuffle_parts
from .encode import encoded
from .rangecoder import BLOCK, LANES, decode_blocks, encode_blocks

FRAME = "part int, frame int, n_ids long, directory binary, body binary"
ENTRY = np.dtype([("doc", "<i8"), ("n", "<u4"), ("null", "u1")])


def _frames(path: str, kind: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def pack(part: int, number: int, docs: list, raws: list[bytes]) -> dict:
        entries = np.zeros(len(docs), ENTRY)
        entries["doc"], entries["null"] = [d or 0 for d in docs], [d is None for d in docs]
        entries["n"] = [len(r) // 4 for r in raws]
        blocks = encode_blocks(np.frombuffer(b"".join(raws), "<u4"))
        body = b"".join([struct.pack("<I", len(b)) + b for b in blocks])
        return {"part": part, "frame": number, "n_ids": int(entries["n"].sum()), "directory": entries.tobytes(), "body": body}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, raws, size, number, part = [], [], 0, 0, 0
        schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("n_ids", pa.int64()), ("directory", pa.binary()), ("body", pa.binary())])
        for piece, ids in encoded(batches, path, kind):
            for p, doc, raw in zip(piece.column("part").to_pylist(), piece.column("doc").to_pylist(), ids, strict=True):
                if docs and (size >= LANES * BLOCK or p != part):
                    yield pa.RecordBatch.from_pylist([pack(part, number, docs, raws)], schema=schema)
                    number = number + 1 if p == part else 0
                    docs, raws, size = [], [], 0
                part = p
                docs.append(doc)
                raws.append(raw + end)
                size += len(raw) // 4 + 1
        if docs:
            yield pa.RecordBatch.from_pylist([pack(part, number, docs, raws)], schema=schema)
    return run


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, kind: str = "word", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each with ``end_id`` after them, as frames under ``out``."""
    d = pick(docs, doc=id_col, text=text_col)
    parts = shuffle_parts(docs)
    starts = range_starts(d, "doc", parts)
    part = F.when(F.col("doc").isNull(), F.lit(len(starts))).otherwise(range_part("doc", starts) - 1) if starts else F.lit(0)
    d = d.withColumn("part", part.cast("int"))
    d = d.repartitionById(len(starts) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc").asc_nulls_last(), F.xxhash64("text"))
    frames = d.select("part", "doc", "text").mapInArrow(_frames(tokenizer_path, kind, end_id), FRAME)
    frames.write.option("compression", "uncompressed").parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, frame, directory, body in zip(*(batch.column(k).to_pylist() for k in ("part", "frame", "directory", "body")), strict=True):
            entries = np.frombuffer(directory, ENTRY)
            blocks, at = [], 0
            while at < len(body):
                (size,) = struct.unpack_from("<I", body, at)
                blocks.append(body[at + 4: at + 4 + size])
                at += 4 + size
            ids = np.concatenate([*decode_blocks(blocks), np.zeros(0, np.uint16)]).astype("<u4").tobytes()
            n = entries["n"].astype(np.int64)
            ends = np.cumsum(n)
            starts = ends - n
            for i in range(0, len(n), 2000):
                s = slice(i, i + 2000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n[s]), part, np.int32)), pa.array(np.full(len(n[s]), frame, np.int32)),
                     pa.array(entries["doc"][s], mask=entries["null"][s].astype(bool)), pa.array(starts[s]), pa.array(n[s]),
                     pa.array([ids[4 * a: 4 * b] for a, b in zip(starts[s], ends[s], strict=True)], pa.binary())],
                    names=["part", "frame", "doc_id", "at", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit), read from the files."""
    frames = spark.read.schema(FRAME).parquet(path)
    sizes = frames.groupBy("part").agg(F.sum("n_ids")).collect()          # one row per written partition
    before, total = {}, 0
    for part, n in sorted(sizes):
        before[part] = total
        total += n
    base = F.get(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before, default=0) + 1)]), F.col("part"))
    w = Window.partitionBy("part").orderBy("frame")
    starts = frames.select("part", "frame", (base + F.sum("n_ids").over(w) - F.col("n_ids")).alias("base"))
    read = frames.mapInArrow(_read, "part int, frame int, doc_id long, at long, n_tokens long, ids binary")
    return read.join(starts, ["part", "frame"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")
