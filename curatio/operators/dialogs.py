"""Dialogue shapes over the long table ``(conv_id, turn, role, text)``.

Everything here is an equi-join or a partial aggregate keyed by
``(conv_id, position)``: no per-dialogue window and no ``collect_list`` in
the hot path, so a single enormous dialogue is spread over many tasks
(AQE splits a skewed join partition) instead of being buffered by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .turns import HUMAN_ROLES, message_pairs


def positions(conv: DataFrame, drop_leading_non_human: bool = True,
              conv_col: str = "conv_id", turn_col: str = "turn",
              role_col: str = "role") -> DataFrame:
    """Adds ``pos``: 0-based position after the optional leading-message rule.

    When the first message of a dialogue is not from the user it is
    dropped and the others shift down by one.  ``turn`` must be dense and
    0-based within each dialogue (checked by ``alternation_report``).
    """
    if not drop_leading_non_human:
        return conv.withColumn("pos", F.col(turn_col))
    shifted = (conv.filter((F.col(turn_col) == 0) & ~F.col(role_col).isin(*HUMAN_ROLES))
               .select(F.col(conv_col), F.lit(1).alias("_shift")))
    return (conv.join(shifted, conv_col, "left")
            .withColumn("pos", F.col(turn_col) - F.coalesce(F.col("_shift"), F.lit(0)))
            .filter(F.col("pos") >= 0)
            .drop("_shift"))


def turn_pairs(conv: DataFrame, drop_leading_non_human: bool = True,
               conv_col: str = "conv_id", text_col: str = "text", **kw) -> DataFrame:
    """Even position = instruction, next message = response, a trailing
    instruction gets ``""``.  Roles are not looked at (as in the reference);
    the leading-message rule is the only role-aware step.  One sorted pass, see ``turns``;
    ``(conv_id, turn)`` must be unique, a row without a turn is left out.

    Output: ``conv_id, pair_idx, instruction, response``.
    """
    return message_pairs(conv, drop_leading_non_human, conv_col, text_col=text_col, **kw).drop("has_response")


def word_count(c: Column) -> Column:
    """Whitespace-separated token count (ASCII whitespace, as both Spark and
    the DuckDB oracle read ``\\S``)."""
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def bucket6(n: Column, width: int = 20) -> Column:
    """Deterministic stand-in class 1..6 from a count (plug-in default for K4)."""
    return F.least(F.lit(6), F.greatest(F.lit(1), F.ceil(n / F.lit(float(width))))).cast("double")


def default_pair_scores(pairs: DataFrame) -> DataFrame:
    """Plug-in default for the complexity / quality scorers (K4 + D10 collapsed):
    complexity from the instruction length, quality from the response length."""
    return (pairs.withColumn("complexity", bucket6(word_count(F.col("instruction"))))
            .withColumn("quality", bucket6(word_count(F.col("response")))))


def final_score(pair_scores: DataFrame, score_cols=("complexity", "quality"),
                conv_col: str = "conv_id") -> DataFrame:
    """Sum over turns of the product of all score columns.

    A plain ``sum`` aggregate, so partial aggregation runs map-side and a
    dialogue with millions of turns costs one row per map task.
    """
    prod = F.lit(1.0)
    for c in score_cols:
        prod = prod * F.col(c).cast("double")
    return pair_scores.groupBy(conv_col).agg(F.sum(prod).alias("final_score"))


def array_final_score(*score_cols: str) -> Column:
    """D2 over score arrays (one entry per turn): the sum over turns of the product
    of all arrays.  Arrays of unequal length are an error; no turns give 0."""
    def both(a: Column, b: Column) -> Column:
        same = F.size(a) == F.size(b)
        return F.when(same, F.zip_with(a, b, lambda x, y: x * y)).otherwise(
            F.raise_error(F.lit("score arrays have unequal lengths")).cast("array<double>"))

    product = F.col(score_cols[0]).cast("array<double>")
    for c in score_cols[1:]:
        product = both(product, F.col(c).cast("array<double>"))
    return F.aggregate(product, F.lit(0.0), lambda a, x: a + x)


def inject_scores(conv_ids: DataFrame, pair_scores: DataFrame, score_col: str,
                  conv_col: str = "conv_id") -> DataFrame:
    """B2: per-pair scores back as one array per dialogue, in pair order;
    dialogues without pairs get ``[]``.  The array is the output format, so
    each dialogue's array is built in one group; bounded by its turn count."""
    agg = (pair_scores.groupBy(conv_col)
           .agg(F.array_sort(F.collect_list(F.struct("pair_idx", F.col(score_col).alias("s")))).alias("_ps")))
    return (conv_ids.select(conv_col).distinct().join(agg, conv_col, "left")
            .select(conv_col, F.coalesce(F.transform("_ps", lambda x: x["s"]),
                                         F.array().cast("array<double>")).alias(f"{score_col}_scores")))


def score_arrays(pair_scores: DataFrame, score_col: str, conv_col: str = "conv_id") -> DataFrame:
    """B2 over pairs that hold a row with a NULL ``pair_idx`` for a dialogue without pairs
    (``turns.message_pairs(keep_empty=True)``): one array per dialogue, no join back to the messages."""
    pair = F.when(F.col("pair_idx").isNotNull(), F.struct("pair_idx", F.col(score_col).alias("s")))
    return (pair_scores.groupBy(conv_col).agg(F.array_sort(F.collect_list(pair)).alias("_ps"))
            .select(conv_col, F.transform("_ps", lambda x: x["s"]).alias(f"{score_col}_scores")))


def dialog_lengths(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Character length of a dialogue by side (instruction = even
    position, response = odd, all)."""
    p = positions(conv, True, conv_col=conv_col)
    ln = F.length("text").cast("long")
    return p.groupBy(conv_col).agg(
        F.sum(F.when(F.col("pos") % 2 == 0, ln).otherwise(0)).alias("instruction_chars"),
        F.sum(F.when(F.col("pos") % 2 == 1, ln).otherwise(0)).alias("response_chars"),
        F.sum(ln).alias("total_chars"),
        F.count(F.lit(1)).alias("n_messages"))


def alternation_report(conv: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """After the leading-message rule a dialogue must alternate
    user/assistant starting with the user.  One row per dialogue with the
    count of out-of-place messages (0 = valid) and whether a leading message
    was dropped.  Aggregates only, so hot dialogues are pre-aggregated."""
    p = positions(conv, True, conv_col=conv_col)
    expected = F.when(F.col("pos") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    dropped = (conv.filter((F.col("turn") == 0) & ~F.col("role").isin(*HUMAN_ROLES))
               .select(conv_col, F.lit(True).alias("dropped_first")))
    rep = p.groupBy(conv_col).agg(
        F.sum((F.col("role") != expected).cast("long")).alias("bad_roles"),
        F.count(F.lit(1)).alias("n_messages"))
    return (rep.join(dropped, conv_col, "left")
            .select(conv_col, "bad_roles", "n_messages",
                    F.coalesce(F.col("dropped_first"), F.lit(False)).alias("dropped_first"),
                    (F.col("bad_roles") == 0).alias("valid")))


def round_numbers(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Round number of every message = user messages at or before it in
    its dialogue.  A global prefix sum over ``(conv_id, turn)`` minus the
    count before the dialogue's first message (a partial ``min`` per
    dialogue), so no dialogue is buffered whole by one task."""
    from .rank import global_prefix_sum
    u = conv.withColumn("_u", (F.col("role").isin(*HUMAN_ROLES)).cast("long"))
    p = global_prefix_sum(u, [F.col(conv_col), F.col(turn_col)], "_u", "_p")
    base = p.groupBy(conv_col).agg(F.min(F.col("_p") - F.col("_u")).alias("_b"))
    return (p.join(base, conv_col)
            .withColumn("round", (F.col("_p") - F.col("_b")).cast("long"))
            .drop("_u", "_p", "_b"))


def cut_suffix(c: Column, n: int = 4) -> Column:
    """Drop the last ``n`` characters (the ``</s>`` end mark)."""
    return F.substring(c, 1, F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def require_messages(df: DataFrame, col: str = "messages") -> tuple[DataFrame, DataFrame]:
    """Rows with a non-empty message array, and the rejected rest
    (a missing column is an error, as in the reference)."""
    if col not in df.columns:
        raise ValueError(f"input has no {col!r} column")
    ok = F.coalesce(F.size(col) > 0, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def new_ids(candidates: DataFrame, selected: DataFrame, id_col: str) -> DataFrame:
    """Candidate ids not already selected (anti join)."""
    return candidates.join(selected.select(id_col), id_col, "left_anti")


def length_sorted(df: DataFrame, text_col: str, partitions: int | None = None) -> DataFrame:
    """F8: rows range-partitioned and sorted by text length, so batches fed to
    a model plug-in hold similar lengths."""
    n = partitions or df.rdd.getNumPartitions()
    return (df.withColumn("_len", F.length(text_col))
            .repartitionByRange(n, "_len").sortWithinPartitions("_len").drop("_len"))


def observe_counts(df: DataFrame, name: str):
    """Row count of a stage, collected as a side effect of the next
    action on the returned frame (no extra job)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
