"""Registered queries for the stores, samples and strict parses, each with keys
that are NULL, repeated or malformed in the supplied tables' terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import indicators as I
from ..operators import sample as SM
from ..operators import store as ST
from ..operators.bucket_store import BucketStore
from ..operators.dialogs import bucket6, positions, turn_pairs, word_count
from ..operators.indicators import distinct_texts
from ..operators.render import TEMPLATES, gathered_messages, render
from ..session import new_folder
from ..sources.tables import table
from .flows import Flow
from .registry import SQL_PAIRS, SQL_POSITIONS, greedy_sql, query


@query("upsert_null_keys", """
WITH c AS (SELECT nullif(role, 'system') AS who, turn FROM conversations),
s AS (SELECT * FROM c WHERE turn < 2),
a AS (SELECT * FROM s UNION ALL (SELECT DISTINCT * FROM c EXCEPT SELECT * FROM s))
SELECT who, turn, count(*)::BIGINT AS n FROM a GROUP BY ALL""")
def upsert_null_keys_q(spark, sf):
    """Insert-if-absent where a key part is NULL; kept rows keep their copies."""
    c = table(spark, sf, "conversations").select(F.nullif("role", F.lit("system")).alias("who"), "turn")
    return ST.insert_if_absent(c.filter("turn < 2"), c, ["who", "turn"]).groupBy("who", "turn").agg(F.count(F.lit(1)).alias("n"))


@query("delete_first", """
SELECT event_id FROM events WHERE event_id NOT IN
  (SELECT min(event_id) FROM events GROUP BY nullif(event_type, 'click'), user_id)""")
def delete_first_q(spark, sf):
    """Of all rows that match a key (NULL included) the lowest id goes."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("kind"))
    return ST.delete_by(e, e, ["kind", "user_id"], first_only=True, id_col="event_id").select("event_id")


@query("update_last", """
WITH u AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p, max_by(o_totalprice, o_orderkey) AS t FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment, coalesce(t, c_acctbal) AS c_acctbal
FROM customer LEFT JOIN u ON o_custkey = c_custkey""")
def update_last_q(spark, sf):
    """Many updates of one id, the last by an order column counts."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"),
                                          F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ST.update_by_id(c, o, "c_custkey", time_col=None, order_col="o_orderkey")


@query("update_missing_ids", """
SELECT DISTINCT 2 * o_custkey AS c_custkey FROM orders WHERE 2 * o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def update_missing_ids_q(spark, sf):
    """Ids of an update that the table does not have."""
    u = table(spark, sf, "orders").select((2 * F.col("o_custkey")).alias("c_custkey"))
    return ST.missing_ids(table(spark, sf, "customer"), u, "c_custkey")


@query("distinct_documents", """
WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN NULL ELSE text END AS t FROM documents)
SELECT min(doc_id) AS doc_id, sha256(t) AS sha FROM d GROUP BY t""")
def distinct_documents_q(spark, sf):
    """One row per distinct text; all NULL texts are one."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.coalesce("lang", F.lit("")) != "de", F.col("text")).alias("t"))
    return distinct_texts(d, "t", "doc_id").select("doc_id", F.sha2("t", 256).alias("sha"))


JUDGE_FORMS = ['{"rate": 7, "reason": "R"}', '{"rate": 7, "reason": "R"} tail', "{'rate': 7, 'reason': 'R'}", '{"rate": "high", "reason": "R"}',
               '{"rate": 7, "reason": "R"}, {"rate": 1, "reason": "S"}', '```json\n{"rate": "7", "reason": "R"}\n```', '{"rate": 7}', "[7]"]
_FORMS_SQL = "[" + ", ".join("'" + f.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for f in JUDGE_FORMS) + "]"


@query("judge_strict", f"""
WITH f AS (SELECT event_id, event_id % 8 AS k, replace(({_FORMS_SQL})[event_id % 8 + 1], 'R', event_type) AS judge FROM events)
SELECT event_id, CASE WHEN k IN (0, 5) THEN 7.0 ELSE -1.0 END::DOUBLE AS rate,
       CASE WHEN k IN (0, 5) THEN event_type ELSE judge END AS reason
FROM f JOIN (SELECT event_id, event_type FROM events) USING (event_id)""")
def judge_strict_q(spark, sf):
    """Only a text that is one whole JSON object with a numeric rate is a judgement."""
    forms = F.array(*[F.lit(f) for f in JUDGE_FORMS])
    e = table(spark, sf, "events").select("event_id", F.replace(F.get(forms, (F.col("event_id") % 8).cast("int")), F.lit("R"), F.col("event_type")).alias("judge"))
    got = T.parse_judge(F.col("judge"))
    return e.select("event_id", got["rate"].alias("rate"), got["reason"].alias("reason"))


@query("sample_count", """
SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id LIMIT 150""")
def sample_count_q(spark, sf):
    """an exact number of rows, seeded (a sampling operator)."""
    return SM.sample_exact(table(spark, sf, "documents"), "doc_id", size=150, seed=7).select("doc_id", "lang")


@query("seeded_order", """
SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':42'), doc_id) - 1 AS place FROM documents""")
def seeded_order_q(spark, sf):
    """the reproducible order of a seeded shuffle, as positions."""
    return SM.shuffle_positions(table(spark, sf, "documents"), "doc_id")


@query("exists_wildcard", """
SELECT coalesce(bool_or(text ILIKE '%th_t %the%'), false) AS found FROM documents""")
def exists_wildcard_q(spark, sf):
    """Case-insensitive existence test whose wildcards stay wildcards."""
    return ST.exists_like(table(spark, sf, "documents"), "text", "%th_t %the%")


@query("filter_flow", greedy_sql(0.2, 10, 1).replace("SELECT r.conv_id, r.final_score", "SELECT r.conv_id AS idx, r.final_score"))
def filter_flow_q(spark, sf):
    """I3 -> C1 -> I5: score arrays of both kinds, their D2 sum, the supplied vectors, the diverse filter."""
    conv = table(spark, sf, "conversations")

    def certain(text: str):
        """Class logits that leave no doubt: the expected score is the length class itself."""
        return lambda pairs: F.get(F.transform(F.array(bucket6(word_count(F.col(text)))), lambda b: F.transform(
            F.sequence(F.lit(1), F.lit(6)), lambda k: F.when(k == b, 0.0).otherwise(-1e6))), F.lit(0))

    scores = [Flow.create("score", score_type=k).transform(conv, certain(text))
              for k, text in (("complexity", "instruction"), ("quality", "response"))]
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")
    return Flow.create("filter", threshold=0.2, data_size=10, check_counts=False).transform(scores, emb).select(
        "idx", "final_score", "sel_rank")


_LOSS_SQL = """
t AS (SELECT conv_id, pair_idx, instruction || ' ' || response AS w, response AS a FROM pairs),
s AS (SELECT *, length(w) - (strpos(reverse(w), reverse(a)) - 1) - length(a) AS st FROM t),
c AS (SELECT conv_id, pair_idx, unnest(regexp_extract_all(w, '\\S+')) AS tok, generate_subscripts(regexp_extract_all(w, '\\S+'), 1) - 1 AS pos,
             len(regexp_extract_all(substr(w, 1, st), '\\S+')) AS n FROM s),
l AS (SELECT conv_id, pair_idx, -avg(-ln(1 + length(tok)) * (1 + pos % 3)) AS loss FROM c JOIN (SELECT conv_id, pair_idx FROM t WHERE a <> '') USING (conv_id, pair_idx)
      WHERE pos >= n GROUP BY ALL),
u AS (SELECT conv_id, pair_idx, unnest(regexp_extract_all(a, '\\S+')) AS tok, generate_subscripts(regexp_extract_all(a, '\\S+'), 1) - 1 AS pos FROM t),
k AS (SELECT conv_id, pair_idx, -avg(-ln(1 + length(tok)) * (1 + pos % 3)) AS loss FROM u GROUP BY ALL)
SELECT conv_id, pair_idx, round(l.loss, 6) AS loss, round(exp(l.loss) / exp(k.loss), 6) AS ifd, round(l.loss / k.loss, 6) AS ifd_loss
FROM t LEFT JOIN l USING (conv_id, pair_idx) LEFT JOIN k USING (conv_id, pair_idx)"""


@query("token_ppl", "WITH " + SQL_PAIRS + "," + _LOSS_SQL)
def token_ppl_q(spark, sf):
    """K3 -> D5/D6: supplied token losses (here from token length and place), the answer from its
    last occurrence on as target, the IFD ratio in both modes; NULL for an empty answer."""
    pairs = turn_pairs(table(spark, sf, "conversations"))
    whole, answer = F.concat_ws(" ", "instruction", "response"), F.col("response")
    keys = ["conv_id", "pair_idx"]

    def losses(text, start):
        words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
        before = F.size(F.regexp_extract_all(F.substring(text, F.lit(1), start), F.lit(r"\S+"), F.lit(0)))
        # the count in a step of its own below the explode: beside it, it would be made once a token
        t = pairs.select(*keys, before.alias("n"), words.alias("w")).select(*keys, "n", F.posexplode_outer("w").alias("pos", "tok"))
        return I.token_losses(t.select(*keys, (-F.log(1 + F.length("tok")) * (1 + F.col("pos") % 3)).alias("logprob"),
                                       (F.col("pos") >= F.col("n")).alias("is_target")), keys)

    cond, alone = losses(whole, I.target_start(whole, answer)), losses(answer, F.lit(0))
    out = cond.select(*keys, F.round("loss", 6).alias("loss"))
    for mode, name in (("ppl", "ifd"), ("loss", "ifd_loss")):
        r = I.loss_ratio(cond, alone, keys, mode, name)
        out = out.join(r.withColumn(name, F.round(name, 6)), keys)
    return out


#: styles whose pieces one SQL expression covers: start, and text between role and message, after it
_PLAIN = {"ADD_COLON_SINGLE": (True, ": ", ""), "ADD_COLON_SPACE_SINGLE": (True, ": ", ""), "NO_COLON_SINGLE": (False, "", ""),
          "ADD_NEW_LINE_SINGLE": (True, "\n", ""), "CHATML": (True, "\n", "\n"), "ROBIN": (True, ":\n", "")}


def _plain_sql() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    rows = []
    for name, style, system, user, bot, sep, _ in TEMPLATES:
        if style in _PLAIN:
            with_sep, middle, tail = _PLAIN[style]
            start = system + (sep + tail if with_sep else "")
            if not system and style in ("ADD_NEW_LINE_SINGLE", "CHATML"):
                start = ""
            bare = ":" if style == "ADD_COLON_SINGLE" else middle        # an empty message: the role and this, no separator
            rows.append("(" + ", ".join(lit(x) for x in (name, start, user + middle, bot + middle, sep + tail, user + bare, bot + bare)) + ")")
    return "WITH " + SQL_POSITIONS + f""",
m AS (SELECT conv_id, pos, CASE WHEN (conv_id + pos) % 5 = 0 THEN '' WHEN (conv_id + pos) % 7 = 0 THEN NULL ELSE text END AS text FROM pos),
t(template, start, u, b, stop, nu, nb) AS (VALUES {", ".join(rows)})
SELECT template, conv_id, sha256(start || string_agg(CASE WHEN coalesce(text, '') = '' THEN CASE WHEN pos % 2 = 0 THEN nu ELSE nb END
                                                          ELSE CASE WHEN pos % 2 = 0 THEN u ELSE b END || text || stop END, '' ORDER BY pos)) AS sha
FROM m, t GROUP BY template, start, conv_id"""


@query("render_plain_templates", _plain_sql())
def render_plain_templates_q(spark, sf):
    """Every dialogue under every template of the single-separator styles, some messages empty or NULL."""
    conv = table(spark, sf, "conversations")
    first = positions(conv).select("conv_id", "turn", "pos")
    empty = F.when((F.col("conv_id") + F.col("pos")) % 5 == 0, F.lit("")).when((F.col("conv_id") + F.col("pos")) % 7 != 0, F.col("text"))
    conv = conv.join(first, ["conv_id", "turn"], "left").withColumn("text", F.when(F.col("pos").isNull(), F.col("text")).otherwise(empty))
    messages = gathered_messages(conv)      # sorted into dialogues once, not once a template
    frames = [render(conv, t[0], gathered=messages).select(F.lit(t[0]).alias("template"), "conv_id", F.sha2("prompt", 256).alias("sha"))
              for t in TEMPLATES if t[1] in _PLAIN]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("store_rewrites", """
WITH u AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p, max_by(o_totalprice, o_orderkey) AS t FROM orders GROUP BY 1),
m AS (SELECT c_custkey, c_nationkey, coalesce(p, c_mktsegment) AS c_mktsegment, coalesce(t, c_acctbal) AS c_acctbal
      FROM customer LEFT JOIN u ON o_custkey = c_custkey),
f AS (SELECT min(c_custkey) AS k FROM m GROUP BY c_nationkey, c_mktsegment HAVING c_mktsegment <> '1-URGENT'),
d AS (SELECT * FROM m WHERE c_custkey NOT IN (SELECT k FROM f) AND c_nationkey <> 3)
SELECT * FROM d UNION ALL
SELECT s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM d)""")
def store_rewrites_q(spark, sf):
    """Customers in a written store; orders update them, the first of each nation and
    segment and all of one nation are deleted, suppliers with free keys are inserted, the store is opened again."""
    path = new_folder(spark)
    made = BucketStore.create(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), path, ["c_custkey"], 16)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"),
                                          F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    made.update(o, "c_custkey", order_col="o_orderkey")
    groups = made.rows().where("c_mktsegment <> '1-URGENT'").select("c_nationkey", "c_mktsegment")
    made.delete(groups, ["c_nationkey", "c_mktsegment"], first_only=True, id_col="c_custkey")
    made.delete(table(spark, sf, "nation").where("n_nationkey = 3").select(F.col("n_nationkey").alias("c_nationkey")), ["c_nationkey"])
    made.insert(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"),
                                                    F.lit(None).cast("string").alias("c_mktsegment"), F.col("s_acctbal").alias("c_acctbal")))
    return BucketStore.open(spark, path).rows()


@query("delete_matching", """
SELECT event_id FROM events WHERE NOT ((event_type IS NULL OR event_type = 'click') AND user_id IN
  (SELECT user_id FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0))""")
def delete_matching_q(spark, sf):
    """Every row that matches a key goes, NULL keys included."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("click")).alias("kind"))
    return ST.delete_by(e, e.where("kind IS NULL").select("kind", "user_id"), ["kind", "user_id"]).select("event_id")
