"""Template store and keyword fill.

A keyword file is a JSON-lines file; every line is one record
(``MAP<STRING,STRING>``).  Template ``i`` is paired with keyword file ``i``
(positional zip turned into an equi-join on ``file_pos``) and filled once
per record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

PROMPT_COLS = ("first_query_prompt", "query_prompt", "answer_prompt", "evaluate_prompt")


def read_keyword_files(spark: SparkSession, paths) -> DataFrame:
    """A4: ``(file_name, file_pos, line_no, kw MAP<STRING,STRING>)``.  Any line
    that is not a JSON object raises (FAILFAST).  ``file_pos`` follows the
    order of ``paths``."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if len(set(paths)) != len(paths):
        raise ValueError("a keyword file is listed twice")
    kw = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    bad = F.when(kw.isNull(), F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("value"))))
    frames = []
    for i, p in enumerate(paths):
        raw = spark.read.text(p).select("value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("_at"),
                                        F.monotonically_increasing_id().alias("_mid"))
        # inside a split rows come in file order; splits are ordered by where they start
        place = F.row_number().over(Window.partitionBy("file_name").orderBy("_at", "_mid")) - 1
        raw = raw.withColumn("line_no", place.cast("long")).filter(F.trim("value") != "")
        frames.append(raw.select("file_name", "line_no", F.coalesce(kw, bad.cast("map<string,string>")).alias("kw"), F.lit(i).alias("file_pos")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def required_key_report(records: DataFrame, key: str = "num") -> DataFrame:
    """A5: per file, whether its first record has ``key`` (a warning only)."""
    return (records.groupBy("file_name", "file_pos")
            .agg(F.min_by(F.map_contains_key("kw", key), F.col("line_no")).alias("has_key")))


def pick_templates(templates: DataFrame, labels, label_cols=("domain_name", "task_name", "cls_name")) -> DataFrame:
    """Templates whose joined label ``domain-task-cls`` is in ``labels``."""
    lab = F.concat_ws("-", *[F.col(c) for c in label_cols])
    return templates.filter(lab.isin(list(labels)))


def fill_bundles(templates: DataFrame, records: DataFrame, prompt_cols=PROMPT_COLS) -> DataFrame:
    """C6 + H3 + G4: template ``file_pos`` i x every record of keyword file i;
    each prompt column filled in one pass, with the placeholders the record
    lacks listed in ``missing``."""
    j = templates.join(records, "file_pos")
    cols = [c for c in prompt_cols if c in templates.columns]
    miss = F.array_distinct(F.flatten(F.array(*[T.missing_keys(F.col(c), F.col("kw")) for c in cols])))
    return j.select(*[c for c in j.columns if c not in cols and c != "kw"],
                    *[T.fill(F.col(c), F.col("kw")).alias(c) for c in cols],
                    miss.alias("missing"), "kw")


def portable_draw(*parts) -> "F.Column":
    """A 32-bit integer from the MD5 of ``"p1:p2:..."``: reproducible by any
    engine (the oracles recompute it)."""
    key = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def round_counts(df: DataFrame, n_col: str, lo: int, hi: int, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``n`` random round counts in ``[lo, hi]`` per row, reproducible
    from (id, position, seed): ``lo + md5("id:i:seed")[:8] mod (hi-lo+1)``."""
    draws = F.transform(F.sequence(F.lit(1), F.col(n_col).cast("int")),
                        lambda i: (F.lit(lo) + F.pmod(portable_draw(F.col(id_col), i, F.lit(seed)),
                                                      F.lit(hi - lo + 1))).cast("int"))
    return df.withColumn("turn", F.when(F.col(n_col) > 0, draws).otherwise(F.array().cast("array<int>")))


def check_args(templates: DataFrame, prompt_col: str, args_col: str) -> DataFrame:
    """H5/H6: parsed args and whether they equal the placeholders in order."""
    parsed = T.parse_args(F.col(args_col))
    return templates.select("*", parsed.alias("parsed_args"),
                            (parsed["input_args"] == T.placeholders(F.col(prompt_col))).alias("args_match"))


PROMPT_TYPES = ("first_query_prompt", "query_prompt", "answer_prompt", "evaluate_prompt")


def bundles_from_typed(typed: DataFrame, keys=("domain_name", "task_name", "cls_name")) -> tuple[DataFrame, DataFrame]:
    """Typed prompt rows ``(*keys, prompt_type, prompt)`` -> one bundle
    row per taxonomy key with the four prompt columns (pivot on a fixed
    value list, so no extra job to find the values).  Keys missing any of
    the four prompts go to the second (rejected) frame."""
    keys = list(keys)
    piv = typed.groupBy(*keys).pivot("prompt_type", list(PROMPT_TYPES)).agg(F.first("prompt"))
    complete = F.lit(True)
    for c in PROMPT_TYPES:
        complete = complete & F.col(c).isNotNull()
    return piv.filter(complete), piv.filter(~complete)


def lookup_bundles(bundles: DataFrame, requests: DataFrame, keys=("domain_name", "task_name", "cls_name")):
    """C8 join: requests matched to their bundle; unmatched requests returned
    separately (the reference raises on a missing template)."""
    keys = list(keys)
    hit = requests.join(bundles, keys, "inner")
    miss = requests.join(bundles.select(*keys), keys, "left_anti")
    return hit, miss
