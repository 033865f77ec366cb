"""Loss masks over rendered dialogues (H25, H26, D3): character spans merged with token offsets.

A rule renders a dialogue and names the character spans that count for the
loss; ``token_masks`` lays the tokens of the rendered text over the spans.  A
token belongs to the span its first character lies in: that is what counting
the tokens of rendered prefixes gives when a boundary falls inside a token.

=========  ============================  ==========================================
rule       rendering                     counts for the loss
=========  ============================  ==========================================
tagged     ``role_tagged``               stripped answer, end mark, newline; also the
                                         role line of an answer no other role precedes
inst       ``inst_format``               answer and end mark
answers    two-separator template        answer and end mark; a dialogue with a round
                                         that is not whole counts nothing, unless
                                         whole rounds fill the token limit
replies    any template                  every second message as rendered, its role too
=========  ============================  ==========================================

The rendering of a dialogue is one output value, so a dialogue is one row
here, as in ``render``; its spans are one running sum, and tokens meet them in
one search.
Null texts count as empty.  A dialogue without messages does not occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .dialogs import positions
from .render import _piece, _start, template

WORDS = r"[^\x20\x09-\x0D]+"
RULES = ("tagged", "inst", "answers", "replies")
#: rows of an Arrow slice and the characters after which a slice ends early
SLICE_ROWS, SLICE_CHARS = 1024, 1 << 20


def _pieces(df: DataFrame, conv_col: str, order: str, piece: Column, skip: Column) -> DataFrame:
    """Per dialogue its pieces in order: text, and the characters before its loss span (null: no span)."""
    row = F.struct(F.col(order).alias("o"), F.col("role").alias("role"), piece.alias("piece"), skip.cast("int").alias("skip"))
    return df.groupBy(conv_col).agg(F.array_sort(F.collect_list(row)).alias("_p"))


def _with_spans(per: DataFrame, start: Column) -> DataFrame:
    """Pieces ``_p`` laid end to end from ``start``: their loss spans, cut to the text, by one running sum a dialogue."""
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def laid(lens: pa.Array, skips: pa.Array, ats: pa.Array, sizes: pa.Array) -> pa.Array:
        """The texts themselves stay out of the Python worker."""
        bounds, length = _bounds(lens), lens.values.to_numpy(zero_copy_only=False).astype(np.int64)
        skip = skips.values.fill_null(-1).to_numpy(zero_copy_only=False)
        shift = _bounds(skips)[0] - bounds[0]
        size = sizes.to_numpy(zero_copy_only=False)
        starts, ends, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
        for i, at in enumerate(ats.to_pylist()):
            n, k = length[bounds[i]:bounds[i + 1]], skip[bounds[i] + shift:bounds[i + 1] + shift]
            end = at + np.cumsum(n)
            begin = np.clip((end - n + k)[k >= 0], 0, size[i])
            starts.append(begin.astype(np.int32)), ends.append(np.clip(end[k >= 0], 0, size[i]).astype(np.int32)), counts.append(len(begin))
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans)

    lens, skips = F.transform("_p", lambda x: F.length(x["piece"])), F.transform("_p", lambda x: x["skip"])
    keep = [c for c in per.columns if not c.startswith("_")]
    return per.select(*keep, laid(lens, skips, start.cast("int"), F.length("text")).alias("spans"))


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each list begins in ``values``, and where the last one ends."""
    return lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int32)


def _joined(start: str) -> Column:
    return F.concat(F.lit(start), F.array_join(F.transform("_p", lambda x: x["piece"]), ""))


def _tagged(conv: DataFrame, conv_col: str, eos: str) -> DataFrame:
    m = strip(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    piece = (F.when(F.col("role").isin("system", "user"), F.concat(head, m, F.lit("\n")))
             .when(F.col("role") == "assistant", F.concat(head, m, F.lit(eos + "\n")))
             .otherwise(F.raise_error(F.concat(F.lit("invalid role: "), F.coalesce("role", F.lit("null"))))))
    per = _pieces(conv, conv_col, "turn", piece, F.when(F.col("role") == "assistant", F.length(head)))
    first = F.transform("_p", lambda x, i: F.when(
        (x["role"] == "assistant") & ((i == 0) | (F.col("_p")[F.greatest(i - 1, F.lit(0))]["role"] == "assistant")),
        x.withField("skip", F.lit(0))).otherwise(x))
    return _with_spans(per.withColumn("_p", first).withColumn("text", _joined("")), F.lit(0))


def _inst(conv: DataFrame, conv_col: str) -> DataFrame:
    m = F.coalesce("text", F.lit(""))
    piece = (F.when(F.col("role") == "user", F.concat(F.lit("<s>[INST] "), strip(m), F.lit(" [/INST]")))
             .when(F.col("role") == "assistant", F.concat(F.lit(" "), m, F.lit(" </s>")))
             .otherwise(F.raise_error(F.concat(F.lit("[INST] format does not take role "), F.coalesce("role", F.lit("null"))))))
    per = (_pieces(conv, conv_col, "turn", piece, F.when(F.col("role") == "assistant", F.lit(0)))
           .withColumn("_all", _joined(""))
           .withColumn("_bare", F.when(F.col("_all").startswith("<s>"), F.substring("_all", 4, 1 << 30)).otherwise(F.col("_all")))
           .withColumn("text", strip(F.col("_bare"))))
    # characters gone in front: the start mark, and the white space before any other character
    gone = F.length("_all") - F.length(strip(F.concat(F.col("_bare"), F.lit(".")))) + 1
    return _with_spans(per, -gone)


def _alternating(conv: DataFrame, conv_col: str, t: dict, skip: Column) -> DataFrame:
    p = positions(conv, True, conv_col=conv_col)
    role = F.when(F.col("pos") % 2 == 0, F.lit(t["user"])).otherwise(F.lit(t["assistant"]))
    per = _pieces(p, conv_col, "pos", _piece(t, F.col("pos"), role, F.col("text")), F.when(F.col("pos") % 2 == 1, skip))
    return _with_spans(per.withColumn("text", _joined(_start(t))), F.lit(len(_start(t))))


def _answers(conv: DataFrame, conv_col: str, t: dict) -> DataFrame:
    """Rounds end at the end mark and hold the answer's head once; ``whole`` is the length up to the first that does not."""
    if t["style"] != "ADD_COLON_TWO":
        raise ValueError("rule answers needs a template of style ADD_COLON_TWO")
    head, eos = t["assistant"] + ": ", t["sep2"]
    out = _alternating(conv, conv_col, t, F.lit(len(head)))
    rounds = F.split("text", "\\Q" + eos + "\\E", -1)
    mark = t["sep"] + head
    # a round is whole if the text before its end mark is one user part and one answer part
    good = lambda r: F.size(F.split(r, "\\Q" + mark + "\\E", -1)) == 2
    closed = F.slice("_r", 1, F.size("_r") - 1)
    n_good = F.aggregate(closed, F.struct(F.lit(0).alias("at"), F.lit(True).alias("on")),
                         lambda a, r: F.when(a["on"] & good(r), F.struct((a["at"] + F.length(r) + len(eos)).alias("at"), F.lit(True).alias("on")))
                         .otherwise(F.struct(a["at"].alias("at"), F.lit(False).alias("on"))))["at"]
    return out.withColumn("_r", rounds).withColumn("whole", n_good.cast("int")).drop("_r")


def loss_spans(conv: DataFrame, rule: str, template_name: str = "vicuna_v1.1", conv_col: str = "conv_id",
               eos: str = "</s>") -> DataFrame:
    """One row a dialogue: ``conv_id, text, spans array<struct<start, end>>`` in code points, by a rule of the table above.

    Rule ``answers`` adds ``whole``: the characters of the leading whole rounds.
    A role that a rendering does not know is an error (tagged, inst).
    """
    if rule == "tagged":
        return _tagged(conv, conv_col, eos)
    if rule == "inst":
        return _inst(conv, conv_col)
    if rule == "answers":
        return _answers(conv, conv_col, template(template_name))
    if rule == "replies":
        return _alternating(conv, conv_col, template(template_name), F.lit(0))
    raise ValueError(f"no loss rule {rule!r}")


def prompt_answer_spans(df: DataFrame, source_col: str, target_col: str) -> DataFrame:
    """Source and target as one text, the target as its loss span; null counts as empty."""
    s, t = F.coalesce(source_col, F.lit("")), F.coalesce(target_col, F.lit(""))
    n = F.length(s)
    return df.withColumns({"text": F.concat(s, t), "spans": F.array(F.struct(n.alias("start"), (n + F.length(t)).alias("end")))})


def word_offsets(texts: list[str]) -> list[list[tuple[int, int]]]:
    """Offsets of the words of each text, split at ASCII white space."""
    find = re.compile(WORDS).finditer
    return [[m.span() for m in find(t)] for t in texts]


def tokenizer_offsets(path: str) -> Callable[[list[str]], list[list[tuple[int, int]]]]:
    """Offsets by a file of the tokenizers library; the file must be at ``path`` on every worker."""
    def offsets(texts):
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        return [e.offsets for e in tok.encode_batch(texts, add_special_tokens=False)]
    return offsets


def _slices(texts: pa.Array):
    """(start, rows) of bounded slices."""
    size = pa.compute.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:at + SLICE_ROWS]), SLICE_CHARS)))
        yield at, min(n, len(texts) - at)
        at += n


def token_masks(spans: DataFrame, max_len: int | None = None, offsets: Callable | None = None) -> DataFrame:
    """Tokens of ``text`` with ``is_target``, cut to ``max_len`` tokens.

    ``offsets(list of texts)`` gives each text's token offsets [start, end) in
    order (default: words).  Spans must be sorted and disjoint.  Returns the
    other columns and ``tokens array<struct<start, end, is_target>>``.
    """
    offsets = offsets or word_offsets
    keep = [c for c in spans.columns if c not in ("spans", "whole", "tokens")]
    token_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("is_target", pa.bool_())]))

    @F.arrow_udf("array<struct<start:int,end:int,is_target:boolean>>")
    def masked(text: pa.Array, lists: pa.Array, wholes: pa.Array) -> pa.Array:
        bounds, flat = _bounds(lists), lists.values
        lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        starts, ends, marks, counts = [], [], [], []
        for at, rows in _slices(text):
            texts, whole = ([*a.slice(at, rows).to_pylist()] for a in (text, wholes))
            texts = [t or "" for t in texts]
            for i, toks in enumerate(offsets(texts)):
                o = np.asarray(toks, np.int32).reshape(-1, 2)
                a, z = lo[bounds[at + i]:bounds[at + i + 1]], hi[bounds[at + i]:bounds[at + i + 1]]
                s = o[:, 0]
                k = np.searchsorted(a, s, "right") - 1          # the last span that starts at or before the token
                on = (k >= 0) & (s < z[k]) if len(a) else np.zeros(len(s), bool)
                if whole[i] is not None and whole[i] < len(texts[i]):
                    # a round that is not whole: nothing counts unless whole rounds fill the limit
                    full = max_len is not None and np.count_nonzero(s < whole[i]) >= max_len
                    on &= full
                # copies, so that the offsets past the limit do not stay in memory
                starts.append(o[:max_len, 0].copy()), ends.append(o[:max_len, 1].copy()), marks.append(on[:max_len].copy()), counts.append(len(marks[-1]))
        cat = lambda xs, t: np.concatenate(xs).astype(t) if xs else np.zeros(0, t)
        values = pa.StructArray.from_arrays([pa.array(cat(starts, np.int32)), pa.array(cat(ends, np.int32)), pa.array(cat(marks, bool))],
                                            fields=list(token_type.value_type))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)

    whole = F.col("whole") if "whole" in spans.columns else F.lit(None).cast("int")
    return spans.select(*keep, masked(F.col("text"), F.col("spans"), whole).alias("tokens"))


def target_texts(masks: DataFrame) -> Column:
    """Texts of the tokens that count, in order."""
    return F.transform(F.filter("tokens", lambda t: t["is_target"]),
                       lambda t: F.substring(F.col("text"), t["start"] + 1, t["end"] - t["start"]))


def completion_report(masks: DataFrame) -> DataFrame:
    """D3: examples, mean tokens and mean tokens that count."""
    n = F.size("tokens")
    hit = F.size(F.filter("tokens", lambda t: t["is_target"]))
    return masks.agg(F.count(F.lit(1)).alias("n_examples"), F.avg(n).alias("avg_tokens"), F.avg(hit).alias("avg_completion_tokens"))
