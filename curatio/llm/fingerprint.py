"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions alone (operator 8).

A paragraph is a line, or a sentence of one; its 64-bit digest is added to three
cells of a sketch, each holding a count, the exclusive-or of digests and that of
their check values.  Subtracting two sketches leaves the differing paragraphs;
cells that hold one digest give it up, which frees others, until all are
recovered.  If that fails, the sketches are made larger with other hashes and
peeled again.  Larger sketches consist of blocks by a hash of the digest; only the
digests of blocks that stay hidden go into the next, and what is left after the
last is compared as sets, so every likeness is exact.

Next documents come from one shuffle: ids are cut into ranges, a window inside
each range gives the next text, and the first document of a range is also sent
to the range before it.

Defined cases: a null text counts as empty; texts without paragraphs are alike;
a null id has no place in the order (its next text is empty); rows that share an
id are ordered by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, range_part, range_starts, shuffle_parts

SPLIT = r"\n|(?<=[.!?])\x20"
BASE_THIRD, THIRD, LOAD, ROUNDS, TRIES = 4, 6, 8, 12, 8
CELL = "struct<c:int,k:bigint,h:bigint>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """The different paragraph digests of a text."""
    return F.array_distinct(F.transform(F.filter(F.split(text, SPLIT, -1), lambda p: p != ""), lambda p: F.xxhash64(p)))


def entries(keys: Column, seed: Column, blocks: Column | None, third: int) -> Column:
    """Digests with their check value, block (if there are several) and three cells."""
    def at(k: Column, j: int) -> Column:
        return (F.pmod(F.xxhash64(k, seed, F.lit(j)), F.lit(third)) + j * third).cast("int")

    own = (lambda k: []) if blocks is None else (lambda k: [block(k, seed, blocks).alias("b")])
    return F.transform(keys, lambda k: F.struct(
        *own(k), k.alias("k"), check(k, seed).alias("h"), at(k, 0).alias("p0"), at(k, 1).alias("p1"), at(k, 2).alias("p2")))


def block(k: Column, seed: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(k, seed, F.lit(9)), blocks).cast("int")


def check(k: Column, seed: Column) -> Column:
    return F.pmod(F.xxhash64(k, seed, F.lit(8)), F.lit(1 << 32))


def thirds(third: int, one) -> Column:
    """one(j) for the three thirds of a block's cells, end to end: an entry has one cell in each."""
    return F.concat(*[one(j) for j in range(3)])


def changed(cell: Column, e: Column, sign) -> Column:
    """A cell after an entry goes in (sign 1) or out."""
    return F.struct((cell["c"] + sign).cast("int").alias("c"), cell["k"].bitwiseXOR(e["k"]).alias("k"), cell["h"].bitwiseXOR(e["h"]).alias("h"))


def sketch(keys: Column, seed: Column, blocks: Column | None, third: int) -> Column:
    """array (blocks, None: one) of arrays (3 * third) of cells."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def cells(own: Column) -> Column:
        return thirds(third, lambda j: F.transform(F.sequence(F.lit(j * third), F.lit((j + 1) * third - 1)), lambda i: F.aggregate(
            F.filter(own, lambda e: e[f"p{j}"] == i), zero, lambda cell, e: changed(cell, e, 1))))

    def blocks_of(every: Column) -> Column:
        """Entries sorted by block: a block is a slice between its first and last place."""
        places = F.transform(every, lambda e: e["b"])
        return let(F.struct(every.alias("e"), places.alias("b"), F.reverse(places).alias("r")), lambda x: F.transform(
            F.sequence(F.lit(0), blocks.cast("int") - 1), lambda b: let(own(x, b), cells)))

    def own(x: Column, b: Column) -> Column:
        first = F.array_position(x["b"], b).cast("int")
        last = F.size(x["b"]) + 1 - F.array_position(x["r"], b).cast("int")
        return F.when(first > 0, F.slice(x["e"], first, last - first + 1)).otherwise(F.slice(x["e"], 1, 0))

    if blocks is None:
        return F.array(let(entries(keys, seed, None, third), cells))
    return let(F.array_sort(entries(keys, seed, blocks, third)), blocks_of)


def minus(a: Column, b: Column) -> Column:
    """The difference of two sketches, cell by cell."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: F.struct(
        (p["c"] - q["c"]).alias("c"), p["k"].bitwiseXOR(q["k"]).alias("k"), p["h"].bitwiseXOR(q["h"]).alias("h"))))


def peeled(cells: Column, seed: Column, third: int) -> Column:
    """Number of digests one block gives up, or null if some stay hidden."""
    def signed(out: Column) -> Column:
        return F.zip_with(entries(F.transform(out, lambda o: o["k"]), seed, None, third), out, lambda e, o: F.struct(
            e["k"].alias("k"), e["h"].alias("h"), e["p0"].alias("p0"), e["p1"].alias("p1"), e["p2"].alias("p2"), o["c"].alias("c")))

    def without(state: Column, out: Column) -> Column:
        left = let(signed(out), lambda es: thirds(third, lambda j: F.transform(
            F.slice(state["cells"], j * third + 1, third), lambda x, i: F.aggregate(
                F.filter(es, lambda e: e[f"p{j}"] == i + j * third), x, lambda cell, e: changed(cell, e, -e["c"])))))
        return F.struct(left.alias("cells"), (state["n"] + F.size(out)).alias("n"), F.lit(True).alias("more"))

    def round_(state: Column, _: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (check(x["k"], seed) == x["h"]))
        given = F.array_distinct(F.transform(pure, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))
        stuck = F.struct(state["cells"].alias("cells"), state["n"].alias("n"), F.lit(False).alias("more"))
        return F.when(state["more"], let(given, lambda out: F.when(F.size(out) > 0, without(state, out)).otherwise(stuck))).otherwise(state)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), F.lit(0).alias("n"), F.lit(True).alias("more")), round_)
    return let(end, lambda e: F.when(~F.exists(e["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0)), e["n"]))


def differing(a: Column, b: Column, seed: Column, third: int) -> Column:
    """Numbers of digests in which the blocks of two sketches differ, null for a block where some stay hidden."""
    return F.transform(minus(a, b), lambda cells: peeled(cells, seed, third))


def likeness(keys_a: Column, keys_b: Column, base_a: Column, base_b: Column) -> Column:
    """Share of common paragraphs among all of both: from the base sketches if they can be peeled, else from larger ones."""
    def state(d: Column, a: Column, b: Column) -> Column:
        return F.struct(d.cast("int").alias("d"), a.alias("a"), b.alias("b"))

    def left(s: Column) -> Column:
        return F.size(s["a"]) + F.size(s["b"])

    def larger(s: Column, i: Column) -> Column:
        blocks = F.greatest(F.lit(1).cast("bigint"), F.ceil(left(s) * F.pow(F.lit(2.0), i - 1) / LOAD).cast("bigint"))

        def after(found: Column) -> Column:
            def hidden(keys: Column) -> Column:
                return F.filter(keys, lambda k: F.get(found, block(k, i, F.size(found).cast("bigint"))).isNull())

            return state(F.aggregate(found, s["d"], lambda n, x: n + F.coalesce(x, F.lit(0))), hidden(s["a"]), hidden(s["b"]))

        return F.when(left(s) == 0, s).otherwise(let(differing(sketch(s["a"], i, blocks, THIRD), sketch(s["b"], i, blocks, THIRD), i, THIRD), after))

    n = F.size(keys_a) + F.size(keys_b)
    base = F.get(differing(base_a, base_b, F.lit(0), BASE_THIRD), F.lit(0))
    none = F.slice(keys_a, 1, 0)
    start = let(base, lambda d: F.when(d.isNull(), state(F.lit(0), keys_a, keys_b)).otherwise(state(d, none, none)))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), start, larger)
    d = let(end, lambda s: s["d"] + left(s) - 2 * F.size(F.array_intersect(s["a"], s["b"])))
    return F.when(n == 0, 1.0).otherwise(let(d, lambda x: (n - x) / (n + x)))


def base_sketch(keys: Column) -> Column:
    return sketch(keys, F.lit(0), None, BASE_THIRD)


def written(sketch_: Column) -> Column:
    """A sketch as text: count, digest and check of every cell in hexadecimal, cells joined by dots."""
    return F.array_join(F.transform(F.flatten(sketch_), lambda x: F.concat_ws(":", F.hex(x["c"].cast("long")), F.hex(x["k"]), F.hex(x["h"]))), ".")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the next document in ascending id order, after the last the first."""
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    parts = 2 * shuffle_parts(docs)
    starts = range_starts(d, "doc_id", parts)
    lone = d.where("doc_id IS NULL").withColumn("next_text", F.lit(""))
    if not starts:
        return lone
    d = d.where("doc_id IS NOT NULL").withColumn("part", range_part("doc_id", starts))
    first = F.get(F.array(*[F.lit(x).cast("bigint") for x in starts]), F.col("part") - 1) == F.col("doc_id")
    before = F.when(F.col("part") == 1, F.lit(len(starts))).otherwise(F.col("part") - 1)
    d = d.withColumn("to", F.explode(F.when(first, F.array(F.struct(F.lit(False).alias("tail"), F.col("part").alias("part")),
                                                           F.struct(F.lit(True).alias("tail"), before.alias("part"))))
                                     .otherwise(F.array(F.struct(F.lit(False).alias("tail"), F.col("part").alias("part"))))))
    w = Window.partitionBy("part").orderBy("tail", "doc_id", "mark")
    d = d.select("to.part", "to.tail", "doc_id", "text", F.xxhash64("text").alias("mark")).withColumn("next_text", F.lead("text").over(w))
    return d.where("NOT tail").select("doc_id", "text", "next_text").unionByName(lone)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its code points replaced by as many first ones of the next document."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text"))
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    d = d.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                 digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("ed"), digests(F.col("next_text")).alias("nx"))
    d = d.select("*", base_sketch(F.col("own")).alias("s_own"), base_sketch(F.col("ed")).alias("s_ed"), base_sketch(F.col("nx")).alias("s_nx"))
    return d.select("doc_id", "n_chars", "edited_sha256", written(F.col("s_own")).alias("fingerprint"), written(F.col("s_ed")).alias("edited_fingerprint"),
                    likeness(F.col("own"), F.col("ed"), F.col("s_own"), F.col("s_ed")).alias("near_edited"),
                    likeness(F.col("own"), F.col("nx"), F.col("s_own"), F.col("s_nx")).alias("near_next"))
