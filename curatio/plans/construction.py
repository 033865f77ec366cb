"""Dialogue construction (I9-I12): filled prompt bundles -> first queries ->
first answers -> extra rounds -> judge score -> stored dialogues.

Generation is the K1 plug-in.  Rounds are a short driver loop over the
round number (at most ``max(turn)`` iterations, each a DataFrame step);
every dialogue is one row holding its message array, bounded by its own
round count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import stored
from ..operators.plugins import default_generation, generate, split_rejected


def _msg(role: str, c):
    return F.struct(F.lit(role).alias("role"), c.alias("content"))


def _history(messages) -> "F.Column":
    """Rendered history text of a message array (B9 format)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(
        F.when(m["role"] == "user", F.lit("[HUMAN]: ")).otherwise(F.lit("[AI]: ")), m["content"], F.lit("\n"))), "")


def construct(bundles: DataFrame, gen=None, query_prompt_for_rounds: bool = True, rejects: list | None = None) -> DataFrame:
    """``bundles(bundle_id, first_query_prompt, query_prompt, answer_prompt,
    evaluate_prompt, turn)`` -> ``(bundle_id, q_idx, messages, rate, reason)``.

    Round ``i`` (i >= 2) is generated iff ``turn >= i``; turn 0 and 1 both
    give one round.  ``query_prompt_for_rounds=False`` reproduces the
    reference, which used the answer prompt for later queries too.

    B7: a dialogue whose query, answer or judgement could not be generated goes no
    further; its ``(bundle_id, q_idx, stage, error)`` is in one of the frames
    appended to ``rejects``, one frame per generating step."""
    def passed(df: DataFrame, col: str, stage: str) -> DataFrame:
        if gen is None:          # the default expression never fails
            return df
        good, bad = split_rejected(df, col)
        if rejects is not None:
            q = F.col("q_idx") if "q_idx" in df.columns else F.lit(None).cast("long")
            rejects.append(bad.select("bundle_id", q.alias("q_idx"), F.lit(stage).alias("stage"), F.col(f"{col}_error").alias("error")))
        return good

    fq = passed(generate(bundles, "bundle_id", "first_query_prompt", "fq", gen, "query"), "fq", "first query")
    # H7: one first query per non-empty line, numbering removed
    lines = fq.select("*", F.posexplode(F.split(T.strip("fq"), "\n")).alias("q_idx", "_q"))
    lines = lines.withColumn("q_idx", F.col("q_idx").cast("long"))
    lines = lines.withColumn("query", T.strip(T.drop_numbering("_q"))).filter(F.col("query") != "")
    d = lines.withColumn("did", F.concat_ws(":", F.col("bundle_id").cast("string"), F.col("q_idx").cast("string")))
    d = d.withColumn("ap", T.fill_query(F.col("answer_prompt"), F.col("query")))
    d = passed(generate(d, "did", "ap", "ans", gen, "answer"), "ans", "first answer")
    d = d.withColumn("messages", F.array(_msg("user", F.col("query")), _msg("assistant", F.col("ans"))))
    d = d.drop("fq", "fq_error", "_q", "ap", "ans", "ans_error")
    max_turn = d.agg(F.max("turn")).first()[0] or 1
    qp = F.col("query_prompt") if query_prompt_for_rounds else F.col("answer_prompt")
    if gen is None:
        # default generator is an expression: a round is a conditional append
        for i in range(2, int(max_turn) + 1):
            live = F.col("turn") >= i
            d = d.withColumn("_nq", F.when(live, default_generation(
                F.concat(qp, F.lit("\n"), _history(F.col("messages"))), "query")))
            d = d.withColumn("_na", F.when(live, default_generation(
                T.fill_query(F.col("answer_prompt"), F.col("_nq")), "answer")))
            d = d.withColumn("messages", F.when(live, F.concat("messages", F.array(
                _msg("user", F.col("_nq")), _msg("assistant", F.col("_na"))))).otherwise(F.col("messages")))
            d = d.drop("_nq", "_na")
    else:
        for i in range(2, int(max_turn) + 1):
            d = stored(d)                          # read twice below; a lost executor re-reads files, nothing is generated again
            active, done = d.filter(F.col("turn") >= i), d.filter(F.coalesce(F.col("turn"), F.lit(0)) < i)
            a = active.withColumn("_p", F.concat(qp, F.lit("\n"), _history(F.col("messages"))))
            a = passed(generate(a, "did", "_p", "_nq", gen, "query"), "_nq", f"query {i}")
            a = a.withColumn("_ap", T.fill_query(F.col("answer_prompt"), F.col("_nq")))
            a = stored(generate(a, "did", "_ap", "_na", gen, "answer"))
            a = passed(a, "_na", f"answer {i}")
            d = done.unionByName(a.withColumn("messages", F.concat("messages", F.array(
                _msg("user", F.col("_nq")), _msg("assistant", F.col("_na"))))).select(*done.columns))
    j = d.withColumn("_jp", F.concat(F.col("evaluate_prompt"), F.lit("\n"), _history(F.col("messages"))))
    j = passed(generate(j, "did", "_jp", "_judge", gen, "judge"), "_judge", "judge")
    parsed = T.parse_judge(F.col("_judge"))
    return j.select("bundle_id", "q_idx", "messages", F.size("messages").alias("n_messages"),
                    parsed["rate"].alias("rate"), parsed["reason"].alias("reason"))


def to_raw_dialog(dialogs: DataFrame) -> DataFrame:
    """Stored form ``(message, turn)`` with the round count."""
    return dialogs.select(F.col("messages").alias("message"), (F.size("messages") / 2).cast("int").alias("turn"))


def construct_by_taxonomy(typed_prompts: DataFrame, requests: DataFrame, gen=None,
                          score_threshold: float | None = None):
    """Requests ``(request_id, domain_name, task_name, cls_name, turn)``
    -> bundle lookup (C8) -> dialogues (I10) -> SFT rows with inputs,
    targets, history text and judge score.  ``score_threshold`` (B21, off
    by default as in the reference) keeps rows scoring at least that much.
    Returns (rows, requests without a template)."""
    from ..operators.prompts import bundles_from_typed, lookup_bundles
    bundles, _ = bundles_from_typed(typed_prompts)
    hit, miss = lookup_bundles(bundles, requests)
    d = construct(hit.withColumnRenamed("request_id", "bundle_id"), gen)
    msgs = F.col("messages")
    inputs = F.transform(F.filter(msgs, lambda m: m["role"] == "user"), lambda m: m["content"])
    targets = F.transform(F.filter(msgs, lambda m: m["role"] == "assistant"), lambda m: m["content"])
    rows = d.select(F.col("bundle_id").alias("request_id"), "q_idx", inputs.alias("inputs"),
                    targets.alias("targets"), _history(msgs).alias("history"), F.col("rate").alias("score"))
    if score_threshold is not None:
        rows = rows.filter(F.col("score") >= F.lit(score_threshold))
    return rows, miss


def answers_for_prompts(filled: DataFrame, id_col: str, prompt_col: str, gen=None) -> DataFrame:
    """One answer per filled prompt, with the (prompt, answer) history
    as JSON text (H28)."""
    a = generate(filled, id_col, prompt_col, "answer", gen, "answer")
    hist = F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col(prompt_col).alias("content")),
                             F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))))
    return a.select(id_col, prompt_col, "answer", hist.alias("history"))
