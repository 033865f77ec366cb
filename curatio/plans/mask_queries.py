"""Registered queries of the loss masks: one a rule, each held against spans recomputed in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks as M
from ..operators.dialogs import turn_pairs
from ..sources.tables import table
from .registry import SQL_PAIRS, SQL_POSITIONS, query

MAX_TOKENS = 256

# pieces(conv_id, o, piece, skip): message renderings and the characters before their loss span; start: text before them
SQL_MASK = r""",
cut AS (SELECT conv_id, skip, piece, {start} + coalesce(sum(length(piece)) OVER (PARTITION BY conv_id ORDER BY o
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pieces),
spans AS (SELECT conv_id, a + skip AS s, a + length(piece) AS e FROM cut WHERE skip IS NOT NULL),
texts AS (SELECT conv_id, {text} AS text FROM pieces GROUP BY conv_id),
bits AS (SELECT conv_id, unnest(regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+')) AS w,
                generate_subscripts(regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+'), 1) AS i FROM texts),
placed AS (SELECT *, sum(length(w)) OVER (PARTITION BY conv_id ORDER BY i) - length(w) AS at FROM bits),
toks AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k FROM placed
         WHERE NOT regexp_matches(w, '^[\x20\x09-\x0D]')),
held AS (SELECT conv_id, w, k, EXISTS (SELECT 1 FROM spans s WHERE s.conv_id = t.conv_id AND t.at >= s.s AND t.at < s.e) AS hit
         FROM toks t WHERE k <= {limit}),
counted AS (SELECT conv_id, count(*)::BIGINT AS n_tokens, sum(hit::INT)::BIGINT AS n_target,
                   md5(coalesce(string_agg(w, ' ' ORDER BY k) FILTER (WHERE hit), '')) AS target_md5 FROM held GROUP BY conv_id)
SELECT conv_id, length(text)::BIGINT AS n_chars, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_target, 0) AS n_target,
       coalesce(target_md5, md5('')) AS target_md5 FROM texts LEFT JOIN counted USING (conv_id)"""

SQL_STRIP = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
SQL_VICUNA = ("A chat between a curious user and an artificial intelligence assistant. "
              "The assistant gives helpful, detailed, and polite answers to the user''s questions. ")
N_VICUNA = len(SQL_VICUNA) - 1


def _digest(masks):
    hit = M.target_texts(masks)
    return masks.select("conv_id", F.length("text").cast("long").alias("n_chars"), F.size("tokens").cast("long").alias("n_tokens"),
                        F.size(hit).cast("long").alias("n_target"), F.md5(F.array_join(hit, " ")).alias("target_md5"))


@query("loss_mask_tagged", "WITH pieces AS (SELECT conv_id, turn AS o, '<|' || role || '|>' || chr(10) || "
       + SQL_STRIP.format("text") + """ || CASE role WHEN 'assistant' THEN '</s>' ELSE '' END || chr(10) AS piece,
       CASE WHEN role <> 'assistant' THEN NULL
            WHEN lag(role, 1, 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN 0 ELSE 14 END AS skip
  FROM conversations)""" + SQL_MASK.format(start=0, text="string_agg(piece, '' ORDER BY o)", limit=MAX_TOKENS))
def loss_mask_tagged_q(spark, sf):
    """Role-tagged rendering of every dialogue, loss on stripped answers and their end marks."""
    return _digest(M.token_masks(M.loss_spans(table(spark, sf, "conversations"), "tagged"), MAX_TOKENS))


@query("loss_mask_inst", "WITH pieces AS (SELECT conv_id, turn AS o, CASE role WHEN 'user' THEN '<s>[INST] ' || "
       + SQL_STRIP.format("text") + """ || ' [/INST]' ELSE ' ' || coalesce(text, '') || ' </s>' END AS piece,
       CASE role WHEN 'assistant' THEN 0 END AS skip FROM conversations WHERE role <> 'system')"""
       + SQL_MASK.format(start=-3, text="substring(string_agg(piece, '' ORDER BY o), 4)", limit=MAX_TOKENS))
def loss_mask_inst_q(spark, sf):
    """[INST] rendering (which has no system messages), loss on answers and their end marks."""
    c = table(spark, sf, "conversations").filter("role <> 'system'")
    return _digest(M.token_masks(M.loss_spans(c, "inst"), MAX_TOKENS))


SQL_COLON = "WITH " + SQL_POSITIONS + """,
pieces AS (SELECT conv_id, pos AS o, CASE WHEN pos % 2 = 0 THEN 'USER' ELSE 'ASSISTANT' END || ':' ||
       CASE WHEN coalesce(text, '') = '' THEN '' ELSE ' ' || text || CASE WHEN pos % 2 = 0 THEN ' ' ELSE '</s>' END END AS piece,
       CASE WHEN pos % 2 = 1 THEN {skip} END AS skip FROM pos)"""
SQL_COLON_TEXT = f"'{SQL_VICUNA}' || string_agg(piece, '' ORDER BY o)"


@query("loss_mask_replies", SQL_COLON.format(skip=0)
       + SQL_MASK.format(start=N_VICUNA, text=SQL_COLON_TEXT, limit=MAX_TOKENS))
def loss_mask_replies_q(spark, sf):
    """Vicuna rendering, loss on every reply as rendered, its role included."""
    return _digest(M.token_masks(M.loss_spans(table(spark, sf, "conversations"), "replies"), MAX_TOKENS))


# no text of the tables holds an end mark or a role head, so a dialogue is whole if it ends with an answer and no answer
# is empty; otherwise its leading rounds (and the 23 words of the system text) before the first that is not whole must fill the limit
@query("loss_mask_answers", SQL_COLON.format(skip=11) + """,
bad AS (SELECT conv_id, min(o) AS o FROM (
          SELECT conv_id, max(o) AS o FROM pieces GROUP BY conv_id HAVING max(o) % 2 = 0
          UNION ALL SELECT conv_id, o - 1 FROM pieces WHERE o % 2 = 1 AND piece = 'ASSISTANT:'
          UNION ALL SELECT conv_id, o FROM pieces WHERE o % 2 = 0 AND piece = 'USER:') GROUP BY conv_id),
before AS (SELECT p.conv_id FROM pieces p JOIN bad b ON p.conv_id = b.conv_id AND p.o < b.o GROUP BY p.conv_id
           HAVING len(regexp_extract_all(string_agg(piece, '' ORDER BY p.o), '[^\\x20\\x09-\\x0D]+')) + 23 >= """ + f"{MAX_TOKENS})"
       + SQL_MASK.format(start=N_VICUNA, text=SQL_COLON_TEXT, limit=MAX_TOKENS).replace(
           "WHERE skip IS NOT NULL)", """WHERE skip IS NOT NULL
          AND (conv_id NOT IN (SELECT conv_id FROM bad) OR conv_id IN (SELECT conv_id FROM before)))"""))
def loss_mask_answers_q(spark, sf):
    """Vicuna rendering, loss on answers and end marks of dialogues whose rounds are whole."""
    return _digest(M.token_masks(M.loss_spans(table(spark, sf, "conversations"), "answers"), MAX_TOKENS))


@query("prompt_answer_mask", "WITH " + SQL_PAIRS + r""",
b AS (SELECT conv_id, pair_idx, instruction || response AS text, length(instruction) AS n,
             regexp_extract_all(instruction || response, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS ws FROM pairs),
u AS (SELECT conv_id, pair_idx, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b),
t AS (SELECT *, sum(length(w)) OVER (PARTITION BY conv_id, pair_idx ORDER BY i) - length(w) AS begin_at FROM u),
c AS (SELECT conv_id, pair_idx, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE begin_at >= n)::BIGINT AS n_target
      FROM t WHERE NOT regexp_matches(w, '^[\x20\x09-\x0D]') GROUP BY ALL)
SELECT b.conv_id, b.pair_idx, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_target, 0) AS n_target
FROM b LEFT JOIN c ON b.conv_id = c.conv_id AND b.pair_idx = c.pair_idx""")
def prompt_answer_mask_q(spark, sf):
    """Source and target of every turn pair as one text, loss on tokens that start in the target."""
    pairs = turn_pairs(table(spark, sf, "conversations")).select("conv_id", "pair_idx", "instruction", "response")
    m = M.token_masks(M.prompt_answer_spans(pairs, "instruction", "response").select("conv_id", "pair_idx", "text", "spans"))
    hit = F.size(F.filter("tokens", lambda t: t["is_target"]))
    return m.select("conv_id", "pair_idx", F.size("tokens").cast("long").alias("n_tokens"), hit.cast("long").alias("n_target"))
