"""Chat formatting by prefix-target expansion, in DataFrame functions alone (operator 6).

A turn is written as ``### role``, a newline, its text and ``</turn>`` with a
newline.  Inside roles and texts the backslash, ``###`` and ``</turn>`` (and in
roles the newline) become two-character codes, so neither mark can occur there
and reading back is exact.  Every assistant turn becomes an example of its own:
all turns before it as context, and a mask over its text alone.

A long conversation of n turns expands to n prefixes; that is the format's own
size.  One conversation's turns are gathered in one row, as its examples are.

Defined cases: a null text or role counts as empty; turns of equal number are
ordered by role and text, a null turn first; rows without a conv_id form one
conversation; turns after the last reply give one more example with an empty
mask, so that every conversation can be read back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TARGET = "### ", "</turn>\n", "assistant"
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_CODES = [*CODES, ("\n", "\\n")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    """Control strings as codes; the backslash first, so every later backslash starts a code."""
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           target: str = TARGET) -> DataFrame:
    """conv_id, example (from 0), target (place of the trained turn, null in an untrained rest), text,
    loss_start and loss_end (code points, end exclusive)."""
    t = turns.select(F.col(conv_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    whole = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = whole.select("conv_id", F.transform("ts", lambda x: F.struct(
        F.concat(F.lit(OPEN), escape(x["role"], ROLE_CODES), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"),
        (x["role"] == target).alias("trained"))).alias("ps"))
    # places of the assistant turns, and the last place if a rest follows them
    size = F.size("ps")
    replies = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("ps", i)["trained"])
    places = F.when(F.get("ps", size - 1)["trained"], replies).otherwise(F.concat(replies, F.array(size - 1)))
    rows = parts.select("conv_id", "ps", F.posexplode(places).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("ps", 1, F.col("at")), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    p = F.get("ps", F.col("at"))
    rows = rows.select("conv_id", "example", F.when(p["trained"], F.col("at")).alias("target"),
                       F.concat(before, p["head"]).alias("lead"), p["body"].alias("body"))
    start = F.length("lead")
    return rows.select("conv_id", "example", "target", F.concat("lead", "body", F.lit(CLOSE)).alias("text"),
                       F.when(F.col("target").isNull(), start + F.length("body")).otherwise(start).alias("loss_start"),
                       (start + F.length("body")).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    pieces = F.split(text, F.lit(CLOSE), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)), ROLE_CODES).alias("role"),
                        unescape(F.substring(piece, F.length(head) + 2, F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(text: str = "text", start: str = "loss_start", end: str = "loss_end") -> Column:
    """The trained text of an example, unescaped."""
    return unescape(F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start)))


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array<struct<role, text>>), losses (trained texts in order), formatted_chars: from the examples alone."""
    got = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.sum(F.length("text")).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", loss_text().alias("loss"))))).alias("ls"))
    return got.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.transform("ls", lambda x: x["loss"]).alias("losses"), "formatted_chars")
