"""Named flows (I1-I8): ``Flow.create(name, **params).transform(...)``.

A registry maps names to classes; a duplicate or unknown name is an
error.  Each pipeline is a chain of DataFrame operators (load, preprocess,
forward, save are explicit steps the caller composes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

_REGISTRY: dict[str, type] = {}


def register(name: str):
    def deco(cls):
        if name in _REGISTRY:
            raise ValueError(f"flow {name!r} already registered")
        _REGISTRY[name] = cls
        return cls
    return deco


class Flow:
    """I1/I2."""

    def __init__(self, **params):
        self.params = params

    @staticmethod
    def create(name: str, **params) -> "Flow":
        if name not in _REGISTRY:
            raise KeyError(f"unknown flow {name!r}; known: {sorted(_REGISTRY)}")
        return _REGISTRY[name](**params)

    def transform(self, *dfs: DataFrame) -> DataFrame:  # pragma: no cover - abstract
        raise NotImplementedError


@register("score")
class ScoreFlow(Flow):
    """Dialogues (long form) -> pairs -> class logits (K4) -> expected
    score (D10) -> one score array per dialogue (B2)."""

    def transform(self, conv: DataFrame, logits_fn=None) -> DataFrame:
        from ..operators.dialogs import score_arrays, word_count
        from ..operators.indicators import expected_score
        from ..operators.plugins import class_logits_from_counts
        from ..operators.turns import message_pairs
        kind = self.params.get("score_type", "complexity")
        if kind not in ("complexity", "quality"):
            raise ValueError("score_type must be complexity or quality")
        pairs = message_pairs(conv, keep_empty=True)
        text = F.col("instruction") if kind == "complexity" else F.col("response")
        lg = logits_fn(pairs) if logits_fn else class_logits_from_counts(word_count(text))
        scored = pairs.withColumn(f"{kind}", expected_score(lg))
        return score_arrays(scored, kind)


@register("embed")
class EmbedFlow(Flow):
    """I4: dialogue text (answer-only or rendered) -> embedding (K2)."""

    def transform(self, conv: DataFrame, embed_fn=None) -> DataFrame:
        from ..operators.plugins import hashed_embedding
        from ..operators.render import answer_only_text, render
        if self.params.get("only_answer"):
            t = answer_only_text(conv).withColumnRenamed("answer_text", "text")
        else:
            t = render(conv, self.params.get("template", "vicuna_simple")).withColumnRenamed("prompt", "text")
        if embed_fn:
            return t.select(F.col("conv_id").alias("idx"), embed_fn(t).alias("embedding"))
        e = hashed_embedding(t, "conv_id", "text", self.params.get("dim", 64))
        return e.select(F.col("conv_id").alias("idx"), "embedding")


@register("filter")
class FilterFlow(Flow):
    """Scores + embeddings (joined on id, C1 with count check) -> D2 ->
    F2/F3 -> selected ids in order, or their ``records`` (C2).

    ``scores`` is one frame or several (``idx`` or ``conv_id``): either with a
    ``final_score``, or with the arrays of ``ScoreFlow``, whose products are
    summed over the turns; ``sort_key`` names them (H27)."""

    def transform(self, scores, embeddings: DataFrame, records: DataFrame | None = None) -> DataFrame:
        from ..functions.text import sort_key_split
        from ..operators.dialogs import array_final_score
        from ..operators.select import greedy_diverse
        from ..sources.io import gather_in_order
        p = self.params
        frames = [f.withColumnRenamed("conv_id", "idx") if "idx" not in f.columns else f
                  for f in (scores if isinstance(scores, (list, tuple)) else [scores])]
        s = frames[0]
        for f in frames[1:]:
            s = s.join(f, "idx")
        if "final_score" not in s.columns:
            s = s.withColumn("final_score", array_final_score(*sort_key_split(p.get("sort_key", ["complexity_scores", "quality_scores"]))))
        j = s.join(embeddings, "idx")
        if p.get("check_counts", True):
            a, b, c = *(f.count() for f in frames[:1]), embeddings.count(), j.count()
            if not (a == b == c):
                raise ValueError(f"scores ({a}) and embeddings ({b}) do not align ({c} matched)")
        out = greedy_diverse(j, tau=p.get("threshold", 0.9), data_size=p.get("data_size", -1),
                             batch_size=p.get("batch_size", 1), id_col="idx", score_col="final_score",
                             metric=p.get("distance_metric", "cosine"))
        if records is None:
            return out
        return gather_in_order(records, out.withColumnRenamed("idx", "conv_id") if "idx" not in records.columns else out,
                               "conv_id" if "idx" not in records.columns else "idx")


@register("influence")
class InfluenceFlow(Flow):
    """Vectors -> influence (C5/D8) -> top ``n``."""

    def transform(self, train: DataFrame, valid: DataFrame, weights: DataFrame) -> DataFrame:
        from ..operators.influence import influence_scores
        s = influence_scores(train, valid, weights)
        n = self.params.get("top_n")
        return s.orderBy(F.col("influence").desc(), "row_id").limit(n) if n else s


@register("indicators")
class IndicatorFlow(Flow):
    """I8: character length, MTLD and kNN-i distance of the whole text of a pair, and PPL, IFD and
    RIFD of its two sides, in one table (``id_col, length, mtld, knn_i, ppl, ifd, rifd``).

    ``pairs(id_col, instruction, response)``, ids are longs.  The perplexities come from the unigram
    default fitted on the same pairs, or as ``perplexities(id_col, ppl, ifd, rifd)`` from any model."""

    def transform(self, pairs: DataFrame, perplexities: DataFrame | None = None, id_col: str = "pair_id") -> DataFrame:
        from ..operators.indicators import mtld, pair_perplexities
        from ..operators.plugins import hashed_embedding
        from ..operators.simjoin import knn_distance
        p, i = self.params, self.params.get("knn_i", 3)
        texts = stored(pairs.select(id_col, "instruction", "response", F.concat_ws("\n", "instruction", "response").alias("whole")))
        emb = hashed_embedding(texts.select(id_col, "whole"), id_col, "whole", p.get("dim", 64), bucket_hash=p.get("bucket_hash", "xxhash64"))
        knn = knn_distance(stored(emb.select(id_col, "embedding")), i, id_col=id_col, vec_col="embedding")
        if perplexities is None:
            perplexities = pair_perplexities(texts, keys=[id_col]).withColumnRenamed("ppl_answer", "ppl")
        main = texts.select(id_col, F.length("whole").cast("long").alias("length"), mtld(F.col("whole")).alias("mtld"))
        return main.join(knn, id_col, "left").join(perplexities.select(id_col, "ppl", "ifd", "rifd"), id_col, "left")


@register("staged_selection")
class StagedSelection(Flow):
    """Quality threshold (B3) -> k-center diversity sample (F7) ->
    generation on the sample (K1) -> reward of the generation (K5) ->
    necessity threshold (B4).  ``triplets(id, instruction, input, output,
    reward_score)``; ``reward_fn(df) -> df + necessity_reward``."""

    def transform(self, triplets: DataFrame, reward_fn=None, gen=None) -> DataFrame:
        from ..functions.text import strip
        from ..operators.plugins import generate, hashed_embedding
        from ..operators.render import instruction_prompt
        from ..operators.select import above, below, kcenter_greedy
        p = self.params
        good = above(triplets, p.get("quality_threshold", 0.0))
        emb = hashed_embedding(good.select("id", "instruction"), "id", "instruction", p.get("dim", 64))
        picks = kcenter_greedy(emb, p.get("k", 100), id_col="id", vec_col="embedding")
        sample = good.join(picks, "id")
        q = F.when(F.coalesce(F.col("input"), F.lit("")) == "", F.col("instruction")).otherwise(
            F.concat_ws("\n", "instruction", "input"))                       # B5 (necessity joins always)
        g = generate(sample.withColumn("_prompt", instruction_prompt(q)), "id", "_prompt", "generated", gen)
        if reward_fn is None:       # default: overlap of generated and reference output words
            ref = F.array_distinct(F.split(strip(F.col("output")), r"\s+"))
            hyp = F.array_distinct(F.split(strip(F.col("generated")), r"\s+"))
            g = g.withColumn("necessity_reward",
                             F.size(F.array_intersect(ref, hyp)) / F.greatest(F.size(ref), F.lit(1)))
        else:
            g = reward_fn(g)
        return below(g, p.get("necessity_threshold", 0.5), "necessity_reward").drop("_prompt")
