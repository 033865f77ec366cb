"""Query registrations (each reads whole supplied tables)."""

from __future__ import annotations

from .registry import ORACLES, greedy_sql, query
from .selection import greedy_selection


@query("greedy_diverse", greedy_sql(0.2, 10, 1))
def greedy_diverse_q(spark, sf):
    """F2 flagship: tau 0.2, data_size 10, batch 1."""
    return greedy_selection(spark, sf, tau=0.2, data_size=10, batch_size=1)


@query("greedy_diverse_batched", greedy_sql(0.2, -1, 4))
def greedy_diverse_batched_q(spark, sf):
    """tau 0.2, no size limit, batches of 4."""
    return greedy_selection(spark, sf, tau=0.2, data_size=-1, batch_size=4)


# ----------------------------------------------------------------- dialogues

from pyspark.sql import functions as F  # noqa: E402

from ..functions import text as T  # noqa: E402
from ..operators import dialogs as DG  # noqa: E402
from ..operators import select as SEL  # noqa: E402
from ..operators.rank import rank_ids  # noqa: E402
from ..session import stored  # noqa: E402
from ..sources.tables import table  # noqa: E402
from .registry import SQL_PAIRS, SQL_POSITIONS, SQL_SCORED  # noqa: E402


@query("turn_pairs", "WITH " + SQL_PAIRS + " SELECT conv_id, pair_idx, instruction, response FROM pairs")
def turn_pairs_q(spark, sf):
    """B1/E1."""
    return DG.turn_pairs(table(spark, sf, "conversations"))


@query("dialog_lengths", "WITH " + SQL_POSITIONS + """
SELECT conv_id,
       sum(CASE WHEN pos % 2 = 0 THEN length(text) ELSE 0 END)::BIGINT AS instruction_chars,
       sum(CASE WHEN pos % 2 = 1 THEN length(text) ELSE 0 END)::BIGINT AS response_chars,
       sum(length(text))::BIGINT AS total_chars, count(*)::BIGINT AS n_messages
FROM pos GROUP BY conv_id""")
def dialog_lengths_q(spark, sf):
    """D12."""
    return DG.dialog_lengths(table(spark, sf, "conversations"))


@query("first_turn_rule", "WITH " + SQL_POSITIONS + """,
rep AS (SELECT conv_id, sum(CASE WHEN role <> CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END
                                 THEN 1 ELSE 0 END)::BIGINT AS bad_roles, count(*)::BIGINT AS n_messages
        FROM pos GROUP BY conv_id)
SELECT conv_id, bad_roles, n_messages, (s.s IS NOT NULL) AS dropped_first, bad_roles = 0 AS valid
FROM rep LEFT JOIN shifted s USING (conv_id)""")
def first_turn_rule_q(spark, sf):
    """B10."""
    return DG.alternation_report(table(spark, sf, "conversations"))


@query("answer_only_text", "WITH " + SQL_POSITIONS + """
SELECT conv_id, string_agg(text, chr(10) ORDER BY pos) AS answer_text
FROM pos WHERE pos % 2 = 1 GROUP BY conv_id""")
def answer_only_text_q(spark, sf):
    """Responses of a dialogue joined by newline (one string per dialogue)."""
    from ..operators.render import answer_only_text
    return answer_only_text(table(spark, sf, "conversations"))


@query("history_text", "WITH " + SQL_PAIRS + """
SELECT conv_id, string_agg('[HUMAN]: ' || instruction || chr(10) || '[AI]: ' || response || chr(10), ''
                           ORDER BY pair_idx) AS history, count(*)::BIGINT AS n_rounds
FROM pairs p WHERE EXISTS (SELECT 1 FROM pos r WHERE r.conv_id = p.conv_id AND r.pos = 2 * p.pair_idx + 1)
GROUP BY conv_id""")
def history_text_q(spark, sf):
    """Zipped (user, assistant) rounds as ``[HUMAN]: ..\\n[AI]: ..\\n``."""
    from ..operators.render import history_text
    return history_text(table(spark, sf, "conversations"))


@query("final_score", "WITH " + SQL_SCORED + """
SELECT conv_id, final_score, (row_number() OVER (ORDER BY final_score DESC, conv_id) - 1)::BIGINT AS rk
FROM sc""")
def final_score_q(spark, sf):
    """D2 + F1: final score and its priority position (score desc, id)."""
    from .selection import scored_dialogs
    scored = scored_dialogs(spark, sf)
    return scored.join(rank_ids(scored, "conv_id", [-F.col("final_score")]), "conv_id")


# ------------------------------------------------------ reward thresholds

def _reward_frame(spark, sf):
    """Triplets from documents with the label table as reward plug-in (K5
    default): question = the whole text (+ source as input, B5), reward from
    labels."""
    from ..operators.indicators import default_reward
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    return default_reward(docs, labels)


SQL_REWARD = """
SELECT d.doc_id,
       CASE WHEN coalesce(d.source, '') = '' THEN d.text ELSE d.text || chr(10) || d.source END AS question,
       (l.quality * 4.0 - l.toxic * 2.0 + ln(1 + d.n_chars) / 2.0)::DOUBLE AS reward_score
FROM documents d JOIN labels l USING (doc_id)"""


@query("quality_filter", SQL_REWARD.replace("SELECT d.doc_id", "SELECT * FROM (SELECT d.doc_id") + ") WHERE reward_score > 5.0")
def quality_filter_q(spark, sf):
    """B3 + B5: keep reward strictly above 5."""
    return SEL.above(_reward_frame(spark, sf), 5.0)


@query("necessity_filter", SQL_REWARD.replace("SELECT d.doc_id", "SELECT * FROM (SELECT d.doc_id") + ") WHERE reward_score < 3.0")
def necessity_filter_q(spark, sf):
    """Keep reward strictly below 3."""
    return SEL.below(_reward_frame(spark, sf), 3.0)


def _hist_sql(tbl: str, col: str) -> str:
    return f"""
WITH b AS (SELECT floor({col})::BIGINT AS lower, ceil({col})::BIGINT AS upper, count(*)::BIGINT AS n
           FROM {tbl} WHERE {col} IS NOT NULL GROUP BY 1, 2)
SELECT lower, upper, n, n / (SELECT count(*) FROM {tbl} WHERE {col} IS NOT NULL)::DOUBLE AS share FROM b"""


@query("score_histogram", _hist_sql("events", "value"))
def score_histogram_q(spark, sf):
    """D1 over events.value."""
    return SEL.score_histogram(table(spark, sf, "events"), "value")


@query("score_histogram_reward", _hist_sql("(" + SQL_REWARD + ")", "reward_score"))
def score_histogram_reward_q(spark, sf):
    """D1 over the reward stand-in (the reference's use)."""
    return SEL.score_histogram(_reward_frame(spark, sf), "reward_score")


# --------------------------------------------------------- text operators

@query("duplicate_texts", """
SELECT sha256(text) AS text_sha, count(*)::BIGINT AS n_copies, min(doc_id) AS first_doc_id
FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_texts_q(spark, sf):
    """Repeated texts (report), keyed by their hash."""
    from ..operators.indicators import duplicate_report
    return duplicate_report(table(spark, sf, "documents"), "text", "doc_id")


def _kw_sql(col: str, keywords, lower: bool) -> str:
    kws = sorted({k.lower() for k in keywords}) if lower else list(dict.fromkeys(keywords))
    lits = ", ".join("'" + k.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k in kws)
    txt = f"lower({col})" if lower else col
    return f"len(list_filter([{lits}], lambda k: strpos({txt}, k) > 0))::BIGINT"


@query("keyword_tags", f"""
SELECT doc_id, {_kw_sql('text', T.MATH_KEYWORDS, True)} AS math_hits,
       {_kw_sql('text', T.CODE_KEYWORDS, False)} AS code_hits FROM documents""")
def keyword_tags_q(spark, sf):
    """Math and code keyword hits per document."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.keyword_hits("text", T.MATH_KEYWORDS, True).alias("math_hits"),
                    T.keyword_hits("text", T.CODE_KEYWORDS, False).alias("code_hits"))


@query("keyword_search", """
SELECT doc_id, lang FROM documents WHERE text ILIKE '%th_t%' OR text ILIKE '%licen%'""")
def keyword_search_q(spark, sf):
    """Case-insensitive substring search; ``_`` and ``%`` stay wildcards."""
    from ..operators.store import keyword_search
    d = table(spark, sf, "documents")
    return keyword_search(d, "text", ["th_t", "licen"]).select("doc_id", "lang")


@query("judge_parse", """
WITH j AS (SELECT event_id,
  CASE WHEN event_type = 'error' THEN 'model failed: ' || props
       WHEN event_type = 'click' THEN '```json' || chr(10) || '{"rate": ' || (floor(value)::BIGINT % 11)::VARCHAR
                                      || ', "reason": "' || event_type || '"}' || chr(10) || '```'
       ELSE '{"rate": ' || (floor(value)::BIGINT % 11)::VARCHAR || ', "reason": "' || event_type || '"}' END AS judge
  FROM events),
b AS (SELECT event_id, judge,
             regexp_replace(regexp_replace(judge, '^\\s*```(json)?\\s*', ''), '\\s*```\\s*$', '') AS body FROM j),
c AS (SELECT event_id, judge, CASE WHEN json_valid(body) AND trim(body) LIKE '{%' THEN body ELSE '{}' END AS jb FROM b),
d AS (SELECT event_id, judge, json_extract_string(jb, '$.rate') AS r, json_extract_string(jb, '$.reason') AS why FROM c)
SELECT event_id,
  CASE WHEN r IS NOT NULL AND why IS NOT NULL THEN TRY_CAST(r AS DOUBLE) ELSE -1.0 END AS rate,
  CASE WHEN r IS NOT NULL AND why IS NOT NULL THEN why ELSE judge END AS reason
FROM d""")
def judge_parse_q(spark, sf):
    """H17 over judge texts derived from events (fenced, plain and failed)."""
    e = table(spark, sf, "events")
    rate = (F.floor("value").cast("long") % 11).cast("string")
    judge = (F.when(F.col("event_type") == "error", F.concat(F.lit("model failed: "), F.col("props")))
             .when(F.col("event_type") == "click",
                   F.concat(F.lit('```json\n{"rate": '), rate, F.lit(', "reason": "'), F.col("event_type"), F.lit('"}\n```')))
             .otherwise(F.concat(F.lit('{"rate": '), rate, F.lit(', "reason": "'), F.col("event_type"), F.lit('"}'))))
    p = T.parse_judge(judge)
    return e.select("event_id", p["rate"].alias("rate"), p["reason"].alias("reason"))


@query("chunked_text", """
SELECT doc_id, (s // 400)::BIGINT AS chunk_idx, substring(text, s + 1, 500) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS s FROM documents)""")
def chunked_text_q(spark, sf):
    """Chunks of 500 characters overlapping by 100."""
    from ..operators.indicators import chunk_text
    return chunk_text(table(spark, sf, "documents"), "doc_id", "text", 500, 100)


@query("stop_token_cut", """
SELECT conv_id, turn, split_part(split_part(split_part(text, '. ', 1), chr(10), 1), ', ', 1) AS cut
FROM conversations WHERE role = 'assistant'""")
def stop_token_cut_q(spark, sf):
    """Cut completions at stop tokens ". ", newline, ", " in that order."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", T.cut_at_stop_tokens("text", [". ", "\n", ", "]).alias("cut"))


@query("numbered_lines", """
SELECT doc_id, (i - 1)::BIGINT AS line_no, regexp_replace(line, '^[0-9]+\\.\\s*', '') AS line
FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS l FROM benchmark
            JOIN (SELECT item_id AS doc_id FROM benchmark) USING (doc_id)))""".replace(
    "FROM benchmark\n            JOIN (SELECT item_id AS doc_id FROM benchmark) USING (doc_id)",
    "FROM (SELECT item_id AS doc_id, text FROM benchmark)"))
def numbered_lines_q(spark, sf):
    """H7 over benchmark items: strip, split on newline, drop ``N.`` prefixes."""
    from ..operators.indicators import numbered_lines
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return numbered_lines(b, "doc_id", "text")


# ------------------------------------------------------------------ vectors

from ..functions import vectors as V  # noqa: E402
from ..operators import simjoin as SJ  # noqa: E402


@query("expected_score", """
WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, unnest(range((len(e) + 5) // 6)) AS head, e FROM l),
x AS (SELECT vec_id, head, e[6 * head + 1 : 6 * head + 6] AS lg FROM g),
y AS (SELECT vec_id, head, lg, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM x)
SELECT vec_id, head::BIGINT AS head,
       CASE WHEN len(lg) < 6 OR list_count(lg) < 6 THEN 3.0
            ELSE list_dot_product(ex, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) / list_sum(ex) END AS expected_score
FROM y""")
def expected_score_q(spark, sf):
    """D10 over all components: six at a time as class logits of one head, the short rest as one with too few."""
    from ..operators.indicators import expected_score
    e = table(spark, sf, "embeddings")
    heads = F.transform(F.sequence(F.lit(0), F.ceil(F.size("embedding") / 6).cast("int") - 1), lambda i: F.slice("embedding", 6 * i + 1, 6))
    rows = e.select("vec_id", F.posexplode(heads).alias("head", "logits"))
    return rows.select("vec_id", F.col("head").cast("long").alias("head"), expected_score(F.col("logits")).alias("expected_score"))


@query("similar_pairs", """
SELECT a.vec_id AS id_a, b.vec_id AS id_b,
       list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3""")
def similar_pairs_q(spark, sf):
    """All pairs with cosine similarity above 0.3 (blocked self-join)."""
    e = table(spark, sf, "embeddings")
    return SJ.similar_pairs(e, 0.3, id_col="vec_id", vec_col="embedding")


@query("knn_i", """
WITH d AS (SELECT a.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
           FROM embeddings a, embeddings b),
r AS (SELECT vec_id, dist, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS rn FROM d)
SELECT vec_id, dist AS knn_3 FROM r WHERE rn = 4""")
def knn_i_q(spark, sf):
    """Distance to the 3rd nearest neighbour (self is the 0th)."""
    e = table(spark, sf, "embeddings")
    return SJ.knn_distance(e, 3, id_col="vec_id", vec_col="embedding")


@query("vector_topk", """
WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0),
d AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(1.0 - list_cosine_similarity(q.v, d.v), 12) AS distance
      FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
      FROM s WHERE distance <= 0.9)
SELECT query_id, doc_id, rank::BIGINT AS rank, distance FROM r WHERE rank <= 3""")
def vector_topk_q(spark, sf):
    """C11: top-3 documents (label <> 0) per query vector (label 0), distance <= 0.9."""
    e = table(spark, sf, "embeddings")
    return SJ.bipartite_topk(e.filter(F.col("label") == 0), e.filter(F.col("label") != 0), 3, 0.9,
                             q_id="vec_id", d_id="vec_id").toDF("query_id", "doc_id", "rank", "distance")


@query("kcenter", """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
kc(step, centers) AS (
  SELECT 1, [(SELECT min(vec_id) FROM e)]
  UNION ALL
  SELECT step + 1, list_append(centers, (
    SELECT vec_id FROM (
      SELECT x.vec_id, min(list_distance(x.v, c.v)) AS md
      FROM e x JOIN e c ON list_contains(kc.centers, c.vec_id) GROUP BY x.vec_id)
    ORDER BY md DESC, vec_id LIMIT 1))
  FROM kc WHERE step < 8)
SELECT unnest(centers) AS vec_id, (generate_subscripts(centers, 1) - 1)::BIGINT AS pick
FROM (SELECT centers FROM kc ORDER BY step DESC LIMIT 1)""")
def kcenter_q(spark, sf):
    """8 centres, first = lowest id."""
    e = table(spark, sf, "embeddings")
    return SEL.kcenter_greedy(e, 8, id_col="vec_id", vec_col="embedding")


@query("kcenter_coreset", """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, ('0x' || substr(md5(vec_id::VARCHAR), 1, 8))::BIGINT
                            % (SELECT greatest(1, (count(*) + 127) // 128) FROM embeddings) AS g FROM embeddings),
kc(step, g, centers) AS (
  SELECT 1, g, [min(vec_id)] FROM e GROUP BY g
  UNION ALL
  SELECT step + 1, g, list_append(centers, (
    SELECT vec_id FROM (
      SELECT x.vec_id, min(list_distance(x.v, c.v)) AS md
      FROM e x JOIN e c ON list_contains(kc.centers, c.vec_id) WHERE x.g = kc.g GROUP BY x.vec_id)
    WHERE md > 0 ORDER BY md DESC, vec_id LIMIT 1))
  FROM kc WHERE step < 8),
u AS (SELECT vec_id, v FROM e WHERE vec_id IN (SELECT unnest(centers) FROM kc WHERE step = 8)),
kd(step, centers) AS (
  SELECT 1, [(SELECT min(vec_id) FROM u)]
  UNION ALL
  SELECT step + 1, list_append(centers, (
    SELECT vec_id FROM (
      SELECT x.vec_id, min(list_distance(x.v, c.v)) AS md
      FROM u x JOIN u c ON list_contains(kd.centers, c.vec_id) GROUP BY x.vec_id)
    WHERE md > 0 ORDER BY md DESC, vec_id LIMIT 1))
  FROM kd WHERE step < 8),
p AS (SELECT unnest(centers) AS vec_id, (generate_subscripts(centers, 1) - 1)::BIGINT AS pick FROM kd WHERE step = 8),
r AS (SELECT max(d) AS radius FROM (SELECT x.vec_id, min(list_distance(x.v, c.v)) AS d
      FROM e x, (SELECT v FROM e JOIN p USING (vec_id)) c GROUP BY x.vec_id))
SELECT vec_id, pick, round(radius, 6) AS radius FROM p, r WHERE vec_id IS NOT NULL""")
def kcenter_coreset_q(spark, sf):
    """F4, coreset mode: 8 centres from groups of about 128 rows, with the radius they cover all rows in."""
    e = table(spark, sf, "embeddings")
    picks = SEL.kcenter_coreset(e, 8, "vec_id", "embedding", group_rows=128)
    radius = SEL.covering_radius(e, picks, "vec_id", "embedding")
    return picks.withColumn("radius", F.round(radius.scalar(), 6))


@query("influence", """
WITH ck AS (SELECT unnest([0, 1, 2]) AS ckpt),
v AS (SELECT e.vec_id AS row_id, e.label, ck.ckpt,
             list_concat(e.embedding[ck.ckpt + 1:], e.embedding[1:ck.ckpt])::DOUBLE[] AS vec
      FROM embeddings e, ck),
w AS (SELECT ckpt, (ckpt + 1) / 6.0 AS weight FROM ck),
tr AS (SELECT * FROM v WHERE label >= 3),
va AS (SELECT * FROM v WHERE label < 3),
p AS (SELECT tr.row_id, va.label AS subtask, va.row_id AS vid,
             sum(w.weight * list_dot_product(tr.vec, va.vec)) AS s
      FROM tr JOIN va ON tr.ckpt = va.ckpt JOIN w ON w.ckpt = tr.ckpt
      GROUP BY tr.row_id, va.label, va.row_id),
m AS (SELECT row_id, subtask, avg(s) AS s FROM p GROUP BY row_id, subtask)
SELECT row_id, max(s) AS influence FROM m GROUP BY row_id""")
def influence_q(spark, sf):
    """Labels 0-2 are validation subtasks, the rest train rows;
    three checkpoints weighted 1:2:3 (normalised)."""
    from ..operators.influence import checkpoint_vectors, influence_scores
    v = checkpoint_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 3)
    train = v.filter(F.col("label") >= 3).select("row_id", "ckpt", "vec")
    valid = v.filter(F.col("label") < 3).select("ckpt", F.col("label").alias("subtask"), "vec")
    weights = spark.range(3).select(F.col("id").cast("int").alias("ckpt"),
                                    (F.col("id") + 1).cast("double").alias("weight"))
    return influence_scores(train, valid, weights)


# ------------------------------------------------------------ prompts, store

TEMPLATE_TEXT = "写{$c_name} from {$n_name}: {$segment} {$$history} {$num} {$关键}"


@query("prompt_fill", """
WITH r AS (SELECT c.c_custkey, c.c_name, n.n_name, c.c_mktsegment
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
t AS (SELECT '""" + TEMPLATE_TEXT + """' AS tpl)
SELECT c_custkey,
       replace(replace(replace(tpl, '{$c_name}', c_name), '{$n_name}', n_name), '{$segment}', c_mktsegment) AS filled,
       array_to_string(list_filter(regexp_extract_all(tpl, '\\{\\$([\\p{L}\\p{N}_]+)\\}', 1),
                                   lambda k: NOT list_contains(['c_name', 'n_name', 'segment'], k)), ',') AS missing,
       array_to_string(regexp_extract_all(tpl, '\\{\\$\\$([\\p{L}\\p{N}_]+)\\}', 1), ',') AS deferred
FROM r, t""")
def prompt_fill_q(spark, sf):
    """One template filled from each customer record
    (customer joined to nation as the keyword record)."""
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    rec = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("n_name"), F.col("n_name"),
                                  F.lit("segment"), F.col("c_mktsegment")).alias("kw"))
    tpl = F.lit(TEMPLATE_TEXT)
    return rec.select("c_custkey", T.fill(tpl, F.col("kw")).alias("filled"),
                      F.array_join(T.missing_keys(tpl, F.col("kw")), ",").alias("missing"),
                      F.array_join(T.placeholders(tpl, deferred=True), ",").alias("deferred"))


@query("upsert_template", """SELECT DISTINCT role, text FROM conversations""")
def upsert_template_q(spark, sf):
    """Store of user messages, then a batch of all messages
    inserted if absent (null-safe match on all fields)."""
    from ..operators.store import insert_if_absent
    conv = table(spark, sf, "conversations")
    store = conv.filter(F.col("role") == "user").select("role", "text").dropDuplicates()
    return insert_if_absent(store, conv.select("role", "text"), ["role", "text"])


@query("render_template", "WITH " + SQL_POSITIONS + """
SELECT conv_id, 'A chat between a curious user and an artificial intelligence assistant. '
       || 'The assistant gives helpful, detailed, and polite answers to the user''s questions. '
       || string_agg(CASE WHEN pos % 2 = 0 THEN 'USER' ELSE 'ASSISTANT' END || ': ' || text
                     || CASE WHEN pos % 2 = 0 THEN ' ' ELSE '</s>' END, '' ORDER BY pos) AS prompt
FROM pos GROUP BY conv_id""")
def render_template_q(spark, sf):
    """Dialogues rendered with the vicuna_v1.1 template."""
    from ..operators.render import render
    return render(table(spark, sf, "conversations"), "vicuna_v1.1")


@query("dataset_stats", """
WITH t AS (SELECT conv_id, sum(len(regexp_extract_all(text, '\\S+'))) AS n_tok,
                  sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(text, '\\S+')) ELSE 0 END) AS n_tgt
           FROM conversations GROUP BY conv_id)
SELECT 'train' AS split, count(*)::BIGINT AS n_rows, avg(n_tok)::DOUBLE AS avg_tokens,
       avg(n_tgt)::DOUBLE AS avg_target_tokens FROM t""")
def dataset_stats_q(spark, sf):
    """Dialogues, mean tokens and mean target (assistant) tokens."""
    from ..operators.dialogs import word_count
    c = table(spark, sf, "conversations")
    wc = word_count(F.col("text"))
    per = c.groupBy("conv_id").agg(F.sum(wc).alias("n_tok"),
                                   F.sum(F.when(F.col("role") == "assistant", wc).otherwise(0)).alias("n_tgt"))
    return per.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n_tok").alias("avg_tokens"),
                   F.avg("n_tgt").alias("avg_target_tokens")).select(F.lit("train").alias("split"), "*")


MTLD_SQL = """
WITH RECURSIVE toks AS (SELECT doc_id, lang, regexp_extract_all(text, '\\S+') AS w FROM documents),
tk AS (SELECT doc_id, 0 AS dir, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM toks
       UNION ALL SELECT doc_id, 1, unnest(list_reverse(w)), generate_subscripts(w, 1) - 1 FROM toks),
pv AS (SELECT doc_id, dir, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id, dir, t ORDER BY pos), -1) AS prev FROM tk),
f(doc_id, dir, s, k) AS (
  SELECT DISTINCT doc_id, dir, 0::BIGINT, 0::BIGINT FROM pv
  UNION ALL
  SELECT doc_id, dir, min(pos) + 1, k + 1 FROM (
    SELECT f.doc_id, f.dir, f.k, pv.pos, pv.pos - f.s + 1 AS n,
           sum(CASE WHEN pv.prev < f.s THEN 1 ELSE 0 END) OVER (PARTITION BY f.doc_id, f.dir ORDER BY pv.pos) AS types
    FROM f JOIN pv ON pv.doc_id = f.doc_id AND pv.dir = f.dir AND pv.pos >= f.s) x
  WHERE types::DOUBLE / n < 0.72 GROUP BY doc_id, dir, k),
e AS (SELECT doc_id, dir, max(s) AS s, max(k) AS k FROM f GROUP BY ALL),
r AS (SELECT e.doc_id, e.dir, e.k, count(pv.pos) AS n, count(*) FILTER (pv.prev < e.s) AS types
      FROM e LEFT JOIN pv ON pv.doc_id = e.doc_id AND pv.dir = e.dir AND pv.pos >= e.s GROUP BY ALL),
c AS (SELECT doc_id, dir, k + CASE WHEN n > 0 THEN (1 - types::DOUBLE / n) / (1 - 0.72::DOUBLE) ELSE 0.0 END AS factors FROM r),
m AS (SELECT doc_id, max(CASE WHEN dir = 0 THEN factors END) AS a, max(CASE WHEN dir = 1 THEN factors END) AS b FROM c GROUP BY doc_id)
SELECT toks.doc_id, lang, CASE WHEN a > 0 AND b > 0 THEN (len(w) / a + len(w) / b) / 2 END AS mtld
FROM toks LEFT JOIN m USING (doc_id)"""


@query("mtld", MTLD_SQL)
def mtld_q(spark, sf):
    """D11 per document (Arrow UDF fold), whole texts."""
    from ..operators.indicators import mtld
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", mtld(F.col("text")).alias("mtld"))


def _ppl_sql() -> str:
    return "WITH " + SQL_PAIRS + """,
corpus AS (SELECT unnest(regexp_extract_all(text, '\\S+')) AS token FROM (SELECT instruction AS text FROM pairs UNION ALL SELECT response FROM pairs)),
cnt AS (SELECT token, count(*) AS c FROM corpus GROUP BY token),
tot AS (SELECT sum(c)::DOUBLE AS n_tokens, count(*)::DOUBLE AS vocab FROM cnt),
tk AS (SELECT conv_id, pair_idx, 'q' AS side, unnest(regexp_extract_all(instruction, '\\S+')) AS token FROM pairs
       UNION ALL SELECT conv_id, pair_idx, 'a', unnest(regexp_extract_all(response, '\\S+')) FROM pairs),
cc AS (SELECT conv_id, pair_idx, side, token, count(*) AS cc FROM tk GROUP BY ALL),
cl AS (SELECT conv_id, pair_idx, side, count(*) AS clen FROM tk GROUP BY ALL),
j AS (SELECT tk.conv_id, tk.pair_idx, tk.side,
             ln((coalesce(cnt.c, 0) + 1) / (tot.n_tokens + tot.vocab)) AS lp,
             ln((coalesce(cnt.c, 0) + coalesce(cc.cc, 0) + 1) / (tot.n_tokens + tot.vocab + coalesce(cl.clen, 0))) AS lpc
      FROM tk CROSS JOIN tot LEFT JOIN cnt USING (token)
      LEFT JOIN cc ON cc.conv_id = tk.conv_id AND cc.pair_idx = tk.pair_idx AND cc.token = tk.token
                   AND cc.side = CASE WHEN tk.side = 'q' THEN 'a' ELSE 'q' END
      LEFT JOIN cl ON cl.conv_id = tk.conv_id AND cl.pair_idx = tk.pair_idx
                   AND cl.side = CASE WHEN tk.side = 'q' THEN 'a' ELSE 'q' END),
g AS (SELECT conv_id, pair_idx, side, exp(-avg(lp)) AS ppl, exp(-avg(lpc)) AS pplc FROM j GROUP BY ALL)
SELECT p.conv_id, p.pair_idx, a.ppl AS ppl_answer, a.pplc AS ppl_answer_given_q, q.ppl AS ppl_question,
       a.pplc / a.ppl AS ifd, q.pplc / q.ppl AS rifd
FROM pairs p LEFT JOIN g a ON a.conv_id = p.conv_id AND a.pair_idx = p.pair_idx AND a.side = 'a'
LEFT JOIN g q ON q.conv_id = p.conv_id AND q.pair_idx = p.pair_idx AND q.side = 'q'"""


@query("unigram_ppl", _ppl_sql())
def unigram_ppl_q(spark, sf):
    """D5/D6/D7 + K3: PPL, IFD and reversed IFD per turn pair under the
    add-one unigram model fitted on the whole dialogue corpus."""
    from ..operators.indicators import pair_perplexities
    return pair_perplexities(DG.turn_pairs(table(spark, sf, "conversations")))


# -------------------------------------------------- category map, clean-up

@query("category_map", """
WITH c AS (SELECT sha256(text) AS instr_sha, source AS category, doc_id FROM documents)
SELECT instr_sha, arg_max(category, doc_id) AS category, count(DISTINCT category)::BIGINT AS n_categories,
       (count(*) - count(DISTINCT category))::BIGINT AS same_category_repeats
FROM c GROUP BY instr_sha""")
def category_map_q(spark, sf):
    """Instruction (whole text) -> category (source), last one by
    position wins; repeats inside a category are counted."""
    d = table(spark, sf, "documents")
    c = d.select(F.sha2("text", 256).alias("instr_sha"), F.col("source").alias("category"), "doc_id")
    return c.groupBy("instr_sha").agg(
        F.max_by("category", "doc_id").alias("category"),
        F.count_distinct("category").alias("n_categories"),
        (F.count(F.lit(1)) - F.count_distinct("category")).alias("same_category_repeats"))


@query("mcq_detect", """
WITH m AS (SELECT doc_id, text,
                  len(regexp_extract_all(text, '(?i)\\([A-D]\\)|[A-D][\\.\\)]|[a-d][\\.\\)]')) AS n_marks FROM documents)
SELECT doc_id, n_marks >= 4 AS is_mcq,
       CASE WHEN n_marks >= 4 THEN length(regexp_extract(text, '(?is)^(.*(?:\\([A-D]\\)|[A-D][\\.\\)]|[a-d][\\.\\)]))', 1))
            ELSE -1 END::BIGINT AS end_pos,
       (strpos(text, chr(10)) - 1)::BIGINT AS next_newline
FROM m""")
def mcq_detect_q(spark, sf):
    """Multiple-choice marks and first newline offset per document."""
    d = table(spark, sf, "documents")
    m = T.mcq(F.col("text"))
    return d.select("doc_id", m["is_mcq"].alias("is_mcq"), m["end_pos"].cast("long").alias("end_pos"),
                    T.next_newline(F.col("text")).cast("long").alias("next_newline"))


@query("instruction_cleanup", None)
def instruction_cleanup_q(spark, sf):
    """User messages cleaned by the gemma-2 and llama-3.1 rules."""
    c = table(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    c = T.clean_instructions(c, "text", "gemma-2", "g")
    c = T.clean_instructions(c, "text", "llama-3.1", "l")
    return c.select("conv_id", "turn", F.col("g.text").alias("gemma_text"), F.col("g.class").alias("gemma_class"),
                    F.col("l.text").alias("llama_text"), F.col("l.class").alias("llama_class"))


# ----------------------------------------------------------------- sampling

@query("sample_exact", """
WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1 AS rk
           FROM documents)
SELECT doc_id, lang FROM r WHERE rk < (SELECT floor(count(*) * 0.1) FROM documents)""")
def sample_exact_q(spark, sf):
    """exactly int(n * 0.1) documents, seeded."""
    from ..operators.sample import sample_exact
    return sample_exact(table(spark, sf, "documents"), "doc_id", share=0.1, seed=42).select("doc_id", "lang")


@query("train_eval_split", """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id::VARCHAR || ':42'), conv_id) - 1 AS rk FROM ids)
SELECT conv_id, CASE WHEN rk < (SELECT floor(count(*) * 0.98) FROM ids) THEN 'train' ELSE 'eval' END AS split
FROM r""")
def train_eval_split_q(spark, sf):
    """98/2 split of the dialogues by seeded permutation."""
    from ..operators.sample import train_eval_split
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return train_eval_split(ids, "conv_id", 0.98, 42)


# ---------------------------------------------------------- construction

FIRST_QUERY_TEMPLATE = "List two questions {$c_name} from {$n_name} might ask:\n1. about orders\n2. about prices"


@query("dialog_construction", """
WITH r AS (SELECT c.c_custkey AS bundle_id, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
t AS (SELECT bundle_id, 1 + (('0x' || substr(md5(bundle_id::VARCHAR || ':1:7'), 1, 8))::BIGINT % 3) AS turn,
             '[query] ' || replace(replace('""" + FIRST_QUERY_TEMPLATE.replace("\n", "' || chr(10) || '") + """', '{$c_name}', c_name),
                                   '{$n_name}', n_name) AS fq FROM r),
l AS (SELECT bundle_id, turn, unnest(string_split(regexp_replace(fq, '^\\s+|\\s+$', '', 'g'), chr(10))) AS line,
             generate_subscripts(string_split(regexp_replace(fq, '^\\s+|\\s+$', '', 'g'), chr(10)), 1) - 1 AS q_idx FROM t)
SELECT bundle_id, q_idx::BIGINT AS q_idx, (2 * greatest(turn, 1))::INTEGER AS n_messages, -1.0::DOUBLE AS rate
FROM l WHERE regexp_replace(regexp_replace(line, '^[0-9]+\\.\\s*', ''), '^\\s+|\\s+$', '', 'g') <> ''""")
def dialog_construction_q(spark, sf):
    """Customer records fill a bundle of four prompts, each gets
    1-3 rounds (F14), dialogues are generated (K1 default) and judged."""
    from ..operators.prompts import round_counts
    from .construction import construct
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    kw = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("n_name"), F.col("n_name"))
    rec = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("bundle_id"), kw.alias("kw"))
    prompts = {
        "first_query_prompt": FIRST_QUERY_TEMPLATE,
        "query_prompt": "Ask a follow-up question as {$c_name}.",
        "answer_prompt": "Answer for {$n_name}: {query}",
        "evaluate_prompt": "Rate the dialogue for {$c_name} as JSON with rate and reason.",
    }
    b = rec.select("bundle_id", *[T.fill(F.lit(v), F.col("kw")).alias(k) for k, v in prompts.items()],
                   F.lit(1).alias("n"))
    b = round_counts(b, "n", 1, 3, seed=7, id_col="bundle_id").withColumn("turn", F.col("turn")[0])
    return construct(b).select("bundle_id", "q_idx", "n_messages", "rate")


# ------------------------------------------------------- more compositions

@query("round_number", """
SELECT conv_id, turn, role,
       sum(CASE WHEN role IN ('user', 'human') THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS round
FROM conversations""")
def round_number_q(spark, sf):
    """Round number of every message (scalable global prefix sum)."""
    return DG.round_numbers(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "round")


@query("influence_top", """
WITH ck AS (SELECT unnest([0, 1, 2]) AS ckpt),
v AS (SELECT e.vec_id AS row_id, e.label, ck.ckpt,
             list_concat(e.embedding[ck.ckpt + 1:], e.embedding[1:ck.ckpt])::DOUBLE[] AS vec
      FROM embeddings e, ck),
va AS (SELECT ckpt, label AS subtask, vec FROM v WHERE label < 3),
p AS (SELECT tr.row_id, va.subtask, avg((tr.ckpt + 1) / 6.0 * list_dot_product(tr.vec, va.vec)) * 3 AS s
      FROM v tr JOIN va ON tr.ckpt = va.ckpt WHERE tr.label >= 3 GROUP BY tr.row_id, va.subtask),
m AS (SELECT row_id, max(s) AS influence FROM p GROUP BY row_id)
SELECT row_id, influence FROM m ORDER BY influence DESC, row_id LIMIT 20""")
def influence_top_q(spark, sf):
    """The 20 most influential training rows (a top-k report)."""
    from ..operators.influence import checkpoint_vectors
    from .flows import Flow
    v = checkpoint_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 3)
    train = v.filter(F.col("label") >= 3).select("row_id", "ckpt", "vec")
    valid = v.filter(F.col("label") < 3).select("ckpt", F.col("label").alias("subtask"), "vec")
    weights = spark.range(3).select(F.col("id").cast("int").alias("ckpt"), (F.col("id") + 1).cast("double").alias("weight"))
    return Flow.create("influence", top_n=20).transform(train, valid, weights)


@query("diversity_sample", "WITH RECURSIVE good AS (SELECT * FROM (" + SQL_REWARD + """) WHERE reward_score > 5.0),
tk AS (SELECT doc_id, unnest(regexp_extract_all(question, '\\S+')) AS t FROM good),
cnt AS (SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS j, count(*)::DOUBLE AS c FROM tk GROUP BY ALL),
nrm AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM cnt GROUP BY doc_id),
grid AS (SELECT g.doc_id, r.j FROM good g, (SELECT unnest(range(64)) AS j) r),
e AS (SELECT grid.doc_id AS vec_id,
             list(coalesce(cnt.c, 0.0) / greatest(coalesce(nrm.n, 0.0), 1e-12) ORDER BY grid.j) AS v
      FROM grid LEFT JOIN cnt USING (doc_id, j) LEFT JOIN nrm USING (doc_id) GROUP BY grid.doc_id),
kc(step, centers) AS (
  SELECT 1, [(SELECT min(vec_id) FROM e)]
  UNION ALL
  SELECT step + 1, list_append(centers, (
    SELECT vec_id FROM (
      SELECT x.vec_id, min(list_distance(x.v, c.v)) AS md
      FROM e x JOIN e c ON list_contains(kc.centers, c.vec_id) GROUP BY x.vec_id)
    WHERE md > 0 ORDER BY md DESC, vec_id LIMIT 1))
  FROM kc WHERE step < 16),
picks AS (SELECT unnest(centers) AS doc_id, (generate_subscripts(centers, 1) - 1)::BIGINT AS pick
          FROM (SELECT centers FROM kc ORDER BY step DESC LIMIT 1))
SELECT p.doc_id, p.pick, g.reward_score FROM picks p JOIN good g USING (doc_id)""")
def diversity_sample_q(spark, sf):
    """Reward above 5 (B3) -> hashed-token embedding (K2, portable
    MD5 buckets) -> 16 k-center picks (F4) -> records in pick order (C2)."""
    from ..operators.plugins import hashed_embedding
    good = SEL.above(_reward_frame(spark, sf), 5.0)
    emb = hashed_embedding(good.select("doc_id", "question"), "doc_id", "question",
                           bucket_hash="md5").select("doc_id", "embedding")
    picks = SEL.kcenter_greedy(emb, 16, id_col="doc_id", vec_col="embedding")
    return good.join(picks, "doc_id").select("doc_id", "pick", "reward_score")


@query("score_arrays", "WITH " + SQL_PAIRS + """,
b AS (SELECT conv_id, pair_idx, least(6, greatest(1, ceil(len(regexp_extract_all(instruction, '\\S+')) / 20.0))) AS b FROM pairs),
k AS (SELECT unnest(range(1, 7)) AS k),
e AS (SELECT conv_id, pair_idx, sum(k * exp(-abs(k - b))) / sum(exp(-abs(k - b))) AS s FROM b, k GROUP BY conv_id, pair_idx)
SELECT c.conv_id, count(e.s)::BIGINT AS n_pairs, coalesce(sum(e.s), 0.0) AS score_sum
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e USING (conv_id) GROUP BY c.conv_id""")
def score_arrays_q(spark, sf):
    """Per-dialogue complexity score arrays (K4 default logits)."""
    from .flows import Flow
    out = Flow.create("score", score_type="complexity").transform(table(spark, sf, "conversations"))
    return out.select("conv_id", F.size("complexity_scores").cast("long").alias("n_pairs"),
                      F.aggregate("complexity_scores", F.lit(0.0), lambda s, x: s + x).alias("score_sum"))


@query("render_chatglm2", "WITH " + SQL_POSITIONS + """
SELECT conv_id, string_agg(CASE WHEN pos % 2 = 0 THEN '[Round ' || (pos // 2 + 1)::VARCHAR || ']' || chr(10) || chr(10) ELSE '' END
                           || CASE WHEN pos % 2 = 0 THEN '问' ELSE '答' END || '：' || text || chr(10) || chr(10),
                           '' ORDER BY pos) AS prompt
FROM pos GROUP BY conv_id""")
def render_chatglm2_q(spark, sf):
    """H18 CHATGLM style (chatglm2: rounds counted from 1)."""
    from ..operators.render import render
    return render(table(spark, sf, "conversations"), "chatglm2")


@query("role_tagged_text", """
SELECT conv_id, string_agg(CASE role WHEN 'system' THEN '<|system|>' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10)
                                     WHEN 'user' THEN '<|user|>' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10)
                                     ELSE '<|assistant|>' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || '</s>' || chr(10) END,
                           '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def role_tagged_text_q(spark, sf):
    """Role-tagged training text of every dialogue (system kept)."""
    from ..operators.render import role_tagged
    return role_tagged(table(spark, sf, "conversations"))



# ---------------------------------------------------------------- projection

def _projection_sql() -> str:
    from ..operators.projection import sign_sql
    return f"""
WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
j AS (SELECT unnest(range(16)) AS j)
SELECT vec_id, j::BIGINT AS j, sum(v * {sign_sql('i', 'j', 7)}) / 4.0 AS value
FROM x, j GROUP BY vec_id, j"""


@query("random_projection", _projection_sql())
def random_projection_q(spark, sf):
    """Embeddings projected to 16 components (Rademacher, seed 7),
    reported one component per row."""
    from ..operators.projection import project
    p = project(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", 16, seed=7)
    return p.select("vec_id", F.posexplode("proj").alias("j", "value")).select(
        "vec_id", F.col("j").cast("long").alias("j"), "value")


def _sizes_sql(kept: str) -> str:
    """Both sizes from shared signs; components for which ``kept`` does not hold count as nothing."""
    from ..operators.projection import sign_sql
    return f"""
WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
j AS (SELECT unnest(range(16)) AS j), s AS (SELECT unnest([4, 16]) AS size),
y AS (SELECT vec_id, j, sum(CASE WHEN {kept} THEN v * {sign_sql('i', 'j', 3)} ELSE 0 END) AS v FROM x, j GROUP BY ALL)
SELECT vec_id, size::BIGINT AS size, j::BIGINT AS j, v / sqrt(size) AS value FROM y JOIN s ON j < size"""


@query("projection_entries", _sizes_sql("v > 0"))
def projection_entries_q(spark, sf):
    """H33, sparse: the positive components of every vector as entries, projected to 4 and to 16 components."""
    from ..operators.projection import project_entries
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return project_entries(e.withColumn("v", F.when(F.col("v") > 0, F.col("v"))), "vec_id", "i", "v", [4, 16], seed=3)


@query("projection_blocks", _sizes_sql("true"))
def projection_blocks_q(spark, sf):
    """H33, long vectors: every vector as blocks of 24 components, projected to 4 and to 16 components."""
    from ..operators.projection import project_blocks
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 24)),
                      lambda b: F.slice("embedding", b * 24 + 1, 24))
    b = table(spark, sf, "embeddings").select("vec_id", F.posexplode(cut).alias("block", "values"))
    return project_blocks(b, "vec_id", "block", "values", 24, [4, 16], seed=3)


def _cleanup_sql() -> str:
    """DuckDB form of the gemma-2 / llama-3.1 clean-up arms (staged CTEs).
    RE2 has no Unicode ``\\w``: letters, digits, marks and ``_`` stand in."""
    w = r"[\p{L}\p{N}\p{M}_]"
    pre = T._PREFIX_RE.replace("(?iU)", "(?i)")
    num = r"^([0-9]+\.|" + w + r"+\))\s*"
    assist = T._ASSIST_RE
    step = T._STEP_RE

    def strip(x):
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"

    def q(s):
        return s.replace("'", "''")

    def rp_stage(src, a, b):
        # two columns: a = numbering removed + strip, b = label prefix removed
        return (f"{strip(f'regexp_replace({src}, {chr(39)}{q(num)}{chr(39)}, {chr(39)}{chr(39)})')} AS {a}",
                f"CASE WHEN regexp_matches({a}, '{q(pre)}') THEN {strip(f'regexp_replace({a}, {chr(39)}{q(pre)}{chr(39)}, {chr(39)}{chr(39)})')} ELSE {a} END AS {b}")

    def bold(x):
        return f"CASE WHEN strpos({x}, '**') = 2 THEN {strip(f'replace({x}, {chr(39)}**{chr(39)}, {chr(39)}{chr(39)})')} ELSE {strip(x)} END"

    a0, b0 = rp_stage("text", "p0", "s0")
    a1, b1 = rp_stage("s0", "p1", "s1")
    out = []
    for fam, llama in (("gemma", False), ("llama", True)):
        c_colon = ("6.1", "6.2", "6.3") if llama else ("5.1", "5.2", "5.3")
        c_plain = ("99.1", "99.2") if llama else ("6.1", "6.2")
        qtext = strip("split_part(s1, '?', 1)") + " || '?'"
        l1 = "l1"
        arms = [
            ("starts_with(s1, '\"') AND hq", strip("replace(split_part(s1, '?', 1), '\"', '')") + " || '?'", "2.1"),
            ("starts_with(s1, '\"')", strip("replace(" + strip("replace(split_part(s1, chr(10), 1), '\"', '')") + ", '*', '')"), "2.2"),
            ("starts_with(s1, '<b>')", strip("replace(s1, '*', '')"), "3.0"),
            ("am", bold(strip("substring(s1, 1, apos)")), "4.0"),
        ]
        if llama:
            arms.append(("sm", bold(strip("substring(s1, 1, spos)")), "5.0"))
        arms += [
            (f"ends_with({l1}, ':') AND strpos(s1, '#') > 0", bold(strip("split_part(s1, '#', 1)")), c_colon[0]),
            (f"ends_with({l1}, ':') AND hq", bold(qtext), c_colon[1]),
            (f"ends_with({l1}, ':')", strip(f"replace({l1}, '*', '')"), c_colon[2]),
            ("hq", bold(qtext), c_plain[0]),
            ("TRUE", strip(f"replace({l1}, '*', '')"), c_plain[1]),
        ]
        txt = "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t, _ in arms) + " END"
        cls = "CASE " + " ".join(f"WHEN {c} THEN {k}" for c, _, k in arms) + " END"
        out.append((fam, txt, cls))
    arm1_src = strip("replace(split_part(s0, '?', 1), '*', '')") + " || '?'"
    ga, gb = rp_stage("g_raw", "g_p", "g_text")
    la, lb = rp_stage("l_raw", "l_p", "l_text")
    xa, xb = rp_stage("a1_raw", "a1_p", "a1_text")
    return f"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
st0 AS (SELECT *, {a0} FROM u),
st1 AS (SELECT *, {b0} FROM st0),
st2 AS (SELECT *, {a1} FROM st1),
st3 AS (SELECT *, {b1} FROM st2),
st4 AS (SELECT *, regexp_matches(s0, '{q(assist)}') AS am,
               length(regexp_extract(s0, '(?s)^(.*?)(?:{q(assist)})', 1)) AS apos,
               regexp_matches(s0, '{q(step)}') AS sm,
               length(regexp_extract(s0, '(?s)^(.*?)(?:{q(step)})', 1)) AS spos,
               starts_with(s0, '*') AND strpos(s0, '?') > 0 AS arm1,
               strpos(s1, '?') > 0 AS hq, {strip("split_part(s1, chr(10), 1)")} AS l1 FROM st3),
st5 AS (SELECT *, {out[0][1]} AS g_raw, {out[0][2]} AS g_cls, {out[1][1]} AS l_raw, {out[1][2]} AS l_cls,
               {arm1_src} AS a1_raw FROM st4),
st6 AS (SELECT *, {ga}, {la}, {xa} FROM st5),
st7 AS (SELECT *, {gb}, {lb}, {xb} FROM st6)
SELECT conv_id, turn,
       CASE WHEN arm1 THEN a1_text ELSE g_text END AS gemma_text,
       (CASE WHEN arm1 THEN 1.0 ELSE g_cls END)::DOUBLE AS gemma_class,
       CASE WHEN arm1 THEN a1_text ELSE l_text END AS llama_text,
       (CASE WHEN arm1 THEN 1.0 ELSE l_cls END)::DOUBLE AS llama_class
FROM st7"""


ORACLES["instruction_cleanup"] = _cleanup_sql()


def _md5_embedding_sql(table_sql: str, id_col: str, text_col: str, dim: int = 64) -> str:
    """Hashed-token embedding (portable MD5 buckets) as SQL over a table."""
    return f"""(WITH src AS ({table_sql}),
tk AS (SELECT {id_col} AS id, unnest(regexp_extract_all({text_col}, '\\S+')) AS t FROM src),
cnt AS (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS j, count(*)::DOUBLE AS c FROM tk GROUP BY ALL),
nrm AS (SELECT id, sqrt(sum(c * c)) AS n FROM cnt GROUP BY id),
grid AS (SELECT s.{id_col} AS id, r.j FROM src s, (SELECT unnest(range({dim})) AS j) r)
SELECT grid.id, list(coalesce(cnt.c, 0.0) / greatest(coalesce(nrm.n, 0.0), 1e-12) ORDER BY grid.j) AS v
FROM grid LEFT JOIN cnt USING (id, j) LEFT JOIN nrm USING (id) GROUP BY grid.id)"""


@query("benchmark_search", """
WITH q AS """ + _md5_embedding_sql("SELECT item_id, text FROM benchmark", "item_id", "text") + """,
d AS """ + _md5_embedding_sql("SELECT doc_id, text FROM documents", "doc_id", "text") + """,
s AS (SELECT q.id AS item_id, d.id AS doc_id, round(1.0 - list_cosine_similarity(q.v, d.v), 12) AS distance FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rank FROM s)
SELECT item_id, doc_id, rank::BIGINT AS rank, distance FROM r WHERE rank <= 3""")
def benchmark_search_q(spark, sf):
    """C11 over text: the 3 documents nearest to every benchmark item
    (hashed-token embeddings, portable MD5 buckets; blocked top-k)."""
    from ..operators.plugins import hashed_embedding
    b = hashed_embedding(table(spark, sf, "benchmark").select("item_id", "text"), "item_id", "text",
                         bucket_hash="md5").select("item_id", "embedding")
    b = stored(b)               # the search reads both sides several times
    d = hashed_embedding(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text",
                         bucket_hash="md5").select("doc_id", "embedding")
    return SJ.bipartite_topk(b, stored(d), 3, q_id="item_id", d_id="doc_id")


_PAIR_TEXTS = "WITH " + SQL_PAIRS + """ SELECT conv_id, pair_idx, conv_id * 1000000 + pair_idx AS pair_id,
instruction || chr(10) || response AS whole FROM pairs"""


@query("indicator_set", f"""
WITH t AS ({_PAIR_TEXTS}),
m AS ({MTLD_SQL.replace("FROM documents", "FROM (SELECT pair_id AS doc_id, '' AS lang, whole AS text FROM (" + _PAIR_TEXTS + "))")}),
e AS {_md5_embedding_sql("SELECT pair_id, whole FROM (" + _PAIR_TEXTS + ")", "pair_id", "whole")},
d AS (SELECT a.id, list_distance(a.v, b.v) AS dist FROM e a, e b),
k AS (SELECT id, dist FROM (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS rn FROM d) WHERE rn = 4),
u AS ({_ppl_sql()})
SELECT t.pair_id, length(whole)::BIGINT AS length, mtld, round(k.dist, 6) AS knn_3, ppl_answer AS ppl, ifd, rifd
FROM t JOIN m ON m.doc_id = t.pair_id LEFT JOIN k ON k.id = t.pair_id JOIN u USING (conv_id, pair_idx)""")
def indicator_set_q(spark, sf):
    """I8: length, MTLD, kNN-3 distance, PPL of the answer, IFD and RIFD of every turn pair."""
    from .flows import Flow
    pairs = DG.turn_pairs(table(spark, sf, "conversations"))
    pairs = pairs.select((F.col("conv_id") * 1_000_000 + F.col("pair_idx")).alias("pair_id"), "instruction", "response")
    out = Flow.create("indicators", knn_i=3, bucket_hash="md5").transform(pairs, id_col="pair_id")
    return out.withColumn("knn_3", F.round("knn_3", 6))


from . import store_queries  # noqa: E402,F401  (registers)
from . import mask_queries  # noqa: E402,F401  (registers)
from . import stream_queries  # noqa: E402,F401  (registers)
