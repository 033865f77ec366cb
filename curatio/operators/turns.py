"""Neighbouring messages of dialogues without gathering a dialogue.

The long table is range-sorted by (dialogue, turn) once; a dialogue longer than a
range goes on in the next one.  One Arrow pass over the sorted rows pairs each
message with the next one inside its range and writes the pairs.  What a range cannot
know comes from its neighbours: the first row of a range is written once more, for
the last row of the range before; and one row a range tells whether its last dialogue
dropped a leading message, which ranges that open inside that dialogue need.  The texts
are read, sorted and written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

HUMAN_ROLES = ("user", "human")
#: kinds of written rows: a pair; a row that is an instruction only if its dialogue dropped
#: ``turn % 2`` messages; both with an unknown next row; the first row and the summary of a range; a dialogue
#: whose only message is dropped, and such a message at the end of a range
PAIR, PARITY, OPEN, OPEN_PARITY, FIRST, RANGE, EMPTY, OPEN_EMPTY = range(8)


def _neighbours(drop_leading: bool):
    """Arrow kernel over one sorted range; columns conv, turn, human, text."""
    names = ["conv", "turn", "instruction", "response", "has_response", "kind", "rng", "shift"]

    def rows_of(table: pa.RecordBatch, shift: np.ndarray, last: bool, rng: int) -> Iterator[pa.RecordBatch]:
        """All rows of ``table`` but the final one, which gives the next texts (``last``: all rows, the final one is open)."""
        conv, turn, text = table.column("conv"), table.column("turn").to_numpy(zero_copy_only=False), table.column("text")
        n = table.num_rows
        if n > 1:
            same = pc.fill_null(pc.equal(conv.slice(0, n - 1), conv.slice(1)), False).to_numpy(zero_copy_only=False)
        else:
            same = np.zeros(0, bool)
        follows = same & (turn[1:] == turn[:-1] + 1)
        m = n if last else n - 1
        kind = np.full(m, -1, np.int8)
        pos = turn[:m] - np.maximum(shift[:m], 0)
        known = shift[:m] >= 0
        kind[known & (pos >= 0) & (pos % 2 == 0)] = PAIR
        kind[~known] = PARITY
        closed = np.append(~same, True)[:m]
        kind[known & (pos < 0) & closed] = EMPTY
        if last:
            kind[-1] = {PAIR: OPEN, PARITY: OPEN_PARITY, EMPTY: OPEN_EMPTY}.get(int(kind[-1]), kind[-1])
        at = pa.array(np.flatnonzero(kind >= 0))
        after = np.append(follows, False)[:m]
        next_row = pa.array(np.minimum(np.arange(m) + 1, n - 1), mask=~after).take(at)
        keep = kind[kind >= 0]
        yield pa.RecordBatch.from_arrays(
            [conv.take(at), pa.array(turn[:m]).take(at), text.take(at), text.take(next_row), pa.array(after).take(at),
             pa.array(keep), pa.array(np.full(len(keep), rng, np.int32)), pa.array(shift[:m].astype(np.int8)).take(at)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng, carry, carried, first = TaskContext.get().partitionId(), None, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if first is None:
                first = batch.slice(0, 1)
            table = batch if carry is None else pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            conv, turn = table.column("conv"), table.column("turn").to_numpy(zero_copy_only=False)
            n = table.num_rows
            fresh = np.ones(n, bool)
            if n > 1:
                fresh[1:] = ~pc.fill_null(pc.equal(conv.slice(0, n - 1), conv.slice(1)), False).to_numpy(zero_copy_only=False)
            human = pc.fill_null(table.column("human"), True).to_numpy(zero_copy_only=False)
            shift = np.where((turn == 0) & ~human & drop_leading, 1, 0)
            if carry is not None:
                shift[0] = carried
            elif drop_leading and turn[0] != 0:
                shift[0] = -1                   # the dialogue may have begun in an earlier range
            shift = shift[np.maximum.accumulate(np.where(fresh, np.arange(n), 0))]
            yield from rows_of(table, shift, False, rng)
            carry, carried = table.slice(n - 1, 1), int(shift[-1])
        if first is not None:
            yield from rows_of(carry, np.array([carried]), True, rng)
            for row, kind in ((first, FIRST), (carry, RANGE)):
                none = pa.nulls(1, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [row.column("conv"), row.column("turn"), row.column("text") if kind == FIRST else none, none, pa.array([False]),
                     pa.array([kind], pa.int8()), pa.array([rng], pa.int32()), pa.array([carried], pa.int8())], names=names)
    return run


def neighbour_rows(conv: DataFrame, drop_leading: bool, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The stored rows of all kinds."""
    rows = conv.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.col(role_col).isin(*HUMAN_ROLES).alias("human"), F.col(text_col).alias("text")).where("turn IS NOT NULL")
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartitionByRange("conv", "turn").sortWithinPartitions("conv", "turn")
    return stored(ordered.mapInArrow(_neighbours(drop_leading), f"conv {kind}, turn long, instruction string, response string, "
                                                               "has_response boolean, kind byte, rng int, shift byte"))


def message_pairs(conv: DataFrame, drop_leading: bool = True, conv_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text", keep_empty: bool = False) -> DataFrame:
    """``conv_id, pair_idx, instruction, response, has_response`` (see ``dialogs.turn_pairs``).

    ``keep_empty``: a dialogue whose only message is the dropped leading one gives one row with a NULL pair."""
    rows = neighbour_rows(conv, drop_leading, conv_col, turn_col, role_col, text_col)
    # one row a range: what the dialogue that goes on into it dropped
    ends = rows.where(F.col("kind") == RANGE).select("rng", F.when(F.col("shift") >= 0, F.struct("conv", "shift")).alias("end"))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    opens = ends.select("rng", F.last("end", ignorenulls=True).over(before).alias("end"))
    heads = rows.where(F.col("kind") == FIRST).select("conv", F.col("turn"), F.col("instruction").alias("head_text"), F.lit(True).alias("found"))
    names = ["conv", "turn", "instruction", "response", "has_response", "shift"]

    def resolved(df: DataFrame) -> DataFrame:
        """Rows of a range's first dialogue, with its shift, if they are instructions under it."""
        shift = F.when(F.col("end.conv") == F.col("conv"), F.col("end.shift")).otherwise(F.lit(0))     # else it begins late, and here
        return (df.drop("shift").join(F.broadcast(opens), "rng").withColumn("shift", shift)        # a row a range
                .where((F.col("turn") >= F.col("shift")) & (F.pmod(F.col("turn") - F.col("shift"), F.lit(2)) == 0)))

    def answered(df: DataFrame) -> DataFrame:
        """The last rows of ranges (one each) with the first row of the range after."""
        h = heads.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), "head_text", "found")
        return (df.join(h, (F.col("conv") == F.col("_c")) & (F.col("turn") + 1 == F.col("_t")), "left")
                .withColumn("response", F.col("head_text")).withColumn("has_response", F.coalesce("found", F.lit(False))))

    kind = F.col("kind")
    out = rows.where(kind == PAIR).select(names)
    for part in (resolved(rows.where(kind == PARITY)), answered(rows.where(kind == OPEN)), answered(resolved(rows.where(kind == OPEN_PARITY)))):
        out = out.unionByName(part.select(names))
    out = out.withColumn("pair_idx", F.floor((F.col("turn") - F.col("shift")) / 2).cast("long"))
    cols = [F.col("conv").alias(conv_col), "pair_idx", "instruction", F.coalesce("response", F.lit("")).alias("response"), "has_response"]
    if keep_empty:
        later = heads.select("conv", F.col("turn").alias("_t"))
        last = rows.where(kind == OPEN_EMPTY)
        lone = last.join(later, (last["conv"] == later["conv"]) & (F.col("turn") < F.col("_t")), "left_anti").select(names)
        none = rows.where(kind == EMPTY).select(names).unionByName(lone)
        out = out.unionByName(none.withColumn("instruction", F.lit(None).cast("string")).withColumn("pair_idx", F.lit(None).cast("long")))
    return out.select(cols)
