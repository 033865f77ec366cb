"""The registered queries opN_<name>: thin digests over the operators, whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.session import checkpoint_dir
from curatio.sources.tables import table

from . import byte_bpe, chat, codes, compact, fingerprint, minhash, packing, pii, quality, search, simhash, suffix, tokenfile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the boosted trees for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *quality.BASE, "base_failed", "kept", "score")


@_query
def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document (five words, similarity 0.75)."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that an earlier one holds, in strings of 50 bytes."""
    return suffix.remove_earlier_copies(table(spark, sf_dir, "documents"), with_bytes=False)


BYTE_BPE = "byte_bpe_50k.json"


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), _vocabulary(BYTE_BPE), end_id=1)
    digest = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digest)


@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the rank file, and the bytes they decode to."""
    import public_tokenizers

    path = _vocabulary("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode_ids(ids, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and digest, and all spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[pii.count_of("base", kind).alias(f"n_{kind}") for kind in pii.KINDS], F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@_query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation (and one whose texts hold control strings) expanded and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("\\### Assistant: </turn> ok").alias("text"))
    back = chat.read_back(chat.expand(turns.unionByName(hard)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


@_query
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of every document and of its edited text, and how alike they are."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that nearly repeat a passage of an earlier document."""
    return compact.near_duplicate_passages(table(spark, sf_dir, "documents")).withColumn(
        "similarity", F.round(F.col("n_common") / F.col("n_union"), 6))


@_query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to token files and read back from them."""
    out = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), out, _vocabulary("word_bpe_49k.json"), end_id=2)
    digest = F.crc32("ids").alias("ids_crc32")
    return tokenfile.read_tokens(spark, out).select("doc_id", "start", "n_tokens", digest)


@_query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and a digest of the codebooks."""
    coded, codebooks = codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error",
                                                 F.lit(codes.codebooks_digest(codebooks)).alias("codebooks_sha256"))


@_query
def op13_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document (three differing bits)."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op11_lexical_search"] = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
q AS (SELECT item_id, t, count(*) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 75 + ((25 * n * docs) // terms) AS m FROM n, c),
f AS (SELECT doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY t),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20"""


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """The rounds written out one after the other, on one row per (vector, part)."""
    assign = """a{i} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
      SELECT v.vec_id, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist
      FROM v JOIN c{i} c USING (p)) GROUP BY ALL),"""
    update = """c{j} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
      SELECT p, e, list(mean ORDER BY k) AS x FROM (
        SELECT p, e, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS mean
        FROM (SELECT v.p, a.e, unnest(v.x) AS x, unnest(range(len(v.x))) AS k FROM v JOIN a{i} a USING (vec_id, p)) GROUP BY ALL)
      GROUP BY ALL) m USING (p, e)),"""
    steps = "\n".join(assign.format(i=i) + "\n" + update.format(i=i, j=i + 1) for i in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM k, range({parts}) r(p)),
c0 AS MATERIALIZED (SELECT p, e, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k
                    QUALIFY e < {entries}) USING (vec_id)),
{steps}
{assign.format(i=rounds)}
r AS (SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN k USING (vec_id)"""


ORACLES["op12_vector_codes"] = _codes_sql(codes.PARTS, codes.ENTRIES, codes.ROUNDS)

ORACLES["op6_chat_formatting"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
e AS (SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) + 1
              + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8 AS size FROM t),
c AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS last
      FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR last))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""

ORACLES["op4_minhash_near_dup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, range(1, greatest(len(w) - 3, 2)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""
