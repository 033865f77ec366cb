"""Vector codes by an integer Walsh-Hadamard search (operator 12).

Components become integers, vectors are cut into equal parts, and every part
position has a small codebook that a few rounds of assignment and averaging
improve.  Parts and entries are padded with zeros to a power of two and go
through the integer Walsh-Hadamard transform, which multiplies every squared
distance by that power.  Squared differences are then added up in sequency order
(coefficients by their number of sign changes), a doubling number of them at a time;
an entry whose sum has passed the whole distance of a first guess is out.  All of it
is 64-bit integers, so distances and ties are exact.

Rounds run over a stored table of the integer vectors.  A task returns one row of
sums per component of an entry; the codebooks (parts x entries x width integers,
whatever the number of vectors) are the only thing that travels.

Defined cases: rows whose vector is null, empty or holds a null or non-finite
component are dropped; shorter vectors are padded with zeros to the longest one, and
that to a multiple of the parts; fewer rows than entries make smaller codebooks;
rows with equal ids are vectors of their own, in the order of their components (a
null id comes last); an empty table gives no rows.  Components too large for exact
64-bit distances are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: rows of a slice that one step of the search holds
ROWS = 4096


def sequency_order(size: int) -> np.ndarray:
    """Rows of the Sylvester matrix by number of sign changes: the bit-reversed Gray code."""
    bits = max(0, size.bit_length() - 1)
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh(x: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of the rows, zero-padded to a power of two, in sequency order."""
    n, width = x.shape
    size = 1 << max(0, width - 1).bit_length()
    y = np.zeros((n, size), np.int64)
    y[:, :width] = x
    step = 1
    while step < size:
        z = y.reshape(n, size // (2 * step), 2, step)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return y[:, sequency_order(size)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of several) and the squared distance times the padded
    width, for transformed rows ``x`` and transformed entries."""
    size = x.shape[1]
    first = x[:, :1] - entries[:, 0]
    sums = first * first
    guess = x - entries[sums.argmin(1)]
    bound = (guess * guess).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    acc, at = sums[row, entry], 1
    while at < size:
        to = min(2 * at, size)
        d = x[row, at:to] - entries[entry, at:to]
        acc = acc + (d * d).sum(1)
        in_ = acc <= bound[row]                # equal sums stay: ties go to the lowest index
        row, entry, acc, at = row[in_], entry[in_], acc[in_], to
    full = np.full((len(x), len(entries)), np.iinfo(np.int64).max)
    full[row, entry] = acc
    best = full.argmin(1)
    return best, full[np.arange(len(x)), best]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as a matrix."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _assign(v: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exact squared distance of every part of every row: two (rows, parts) arrays."""
    parts, _, width = codebooks.shape
    cut = v.reshape(len(v), parts, width)
    code, error = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
    for p in range(parts):
        x, e = walsh(cut[:, p]), walsh(codebooks[p])
        code[:, p], scaled = nearest(x, e)
        error[:, p] = scaled // x.shape[1]
    return code, error


def _sums(codebooks: np.ndarray):
    """Arrow kernel: what a task's parts add to each component of each entry."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, v in _slices(batch):
                code, _ = _assign(v, codebooks)
                cut = v.reshape(len(v), parts, width)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], cut[:, p])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        used = np.repeat(count.ravel(), width)
        place = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place]), pa.array(used[place])], names=["place", "total", "n"])
    return run


def _encode(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v in _slices(batch):
                code, error = _assign(v, codebooks)
                text, width = code.astype(np.uint8).tobytes().hex(), 2 * code.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([text[i: i + width] for i in range(0, len(text), width)], pa.string()),
                     pa.array(error.sum(1))], names=["vec_id", "label", "code", "error"])
    return run


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """Stored table id, label, v (longs, all of one length) of the kept rows, and that length."""
    rows = pick(vectors, id=id_col, label=label_col, v=vec_col).where(F.size("v") > 0)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad).withColumn("v", F.transform("v", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))))
    rows = materialize(rows)
    r = rows.agg(F.max(F.size("v")).alias("d"), F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("most")).first()
    if r["d"] is None:
        return rows, 0
    length = -(-r["d"] // parts) * parts
    width = length // parts
    if (1 << max(0, width - 1).bit_length()) * width * (2 * int(r["most"])) ** 2 >= 1 << 62:
        raise ValueError(f"components of {r['most']} / {SCALE} are too large for exact 64-bit distances")
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v")))
    return rows.withColumn("v", F.when(F.size("v") < length, pad).otherwise(F.col("v"))), length


def first_vectors(rows: DataFrame, n: int) -> np.ndarray:
    """Vectors of the n smallest ids: the ids alone are ordered first, then only rows up to the last of them."""
    ids = [r["id"] for r in rows.select("id").orderBy(F.asc_nulls_last("id")).limit(n).collect()]
    some = rows if ids[-1] is None else rows.where(F.col("id") <= F.lit(ids[-1]))
    return np.array([r["v"] for r in some.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(n).collect()], np.int64)


def train(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) after the given number of rounds."""
    start = first_vectors(rows, entries)
    codebooks = start.reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(codebooks), "place long, total long, n long")
        flat = codebooks.ravel()
        for r in sums.groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():   # a row for each component of the codebooks
            flat[r["place"]] = r["total"] // r["n"]
        codebooks = flat.reshape(codebooks.shape)
    return codebooks


def codebooks_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept row, and the codebooks.  At most 256 entries (two hex digits a part)."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    rows, length = integer_vectors(vectors, id_col, vec_col, label_col, parts)
    if not length:
        kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
        return rows.sparkSession.createDataFrame([], f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    codebooks = train(rows, length, parts, entries, rounds)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    coded = rows.mapInArrow(_encode(codebooks), f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")
    return materialize(coded), codebooks


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the error summed over rows of an equal label (nulls together)."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
