"""Similarity joins of sets, without blocks that lose pairs: every pair whose Jaccard similarity reaches a bound, by bit signatures.

Each item sets one of BITS bits of its set's signature; the commonest have a bit each, the others share what is left by their hash. A bit that two signatures differ in stands for an item at least that only
one of the sets has, so signatures that differ in more bits than the sets may differ in items rule a pair out, for two machine
words and no look at the items. All pairs are compared so, blocks of BLOCK signatures against each other, each pair of blocks a
group of its own: memory is bounded by the block, the shuffle is the signatures once a block. What is left is counted exactly.
The bound is a fraction of whole numbers, so no rounding decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions.times import let
from lanewise.operators.core import settled

#: Bits of a signature, in words of 64; how many items have one of their own at most, and from which share of the sets on.
BITS, OWN, OFTEN = 128, 96, 0.2
#: Signatures of a block; how many of them are compared with a block at a time.
BLOCK, STRIP = 20_000, 64


def grams(text: Column, q: int = 3) -> Column:
    """The different q-grams of a text, with q - 1 marks before and behind it."""
    padded = F.concat(F.repeat(F.lit("\u0001"), F.lit(q - 1)), text, F.repeat(F.lit("\u0002"), F.lit(q - 1)))
    return let(padded, lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - (q - 1)), lambda k: F.substring(t, k, F.lit(q)))))


def letters(text: Column) -> Column:
    """The characters of a text as a multiset: each with its running number among its equals, of all characters that it has."""
    numbered = lambda each: F.transform(each, lambda c, k: F.concat(c, (k - F.array_position(each, c) + 1).cast("string")))
    return F.array_distinct(let(F.sort_array(F.split(text, "")), numbered))


def _signed(sets: DataFrame, n: int) -> DataFrame:
    """The n sets (id, items, weight) as (id, weight, word_0, ...): the words of their signatures."""
    each = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    # at most OWN items come to the driver: those that tell most sets apart
    own = [r.item for r in each.where(F.col("n") >= OFTEN * n).orderBy(F.desc(F.col("n") * (n - F.col("n"))), "item").limit(OWN).collect()]
    places = F.array(*map(F.lit, own)) if own else None
    shared = lambda x: F.lit(len(own)) + F.pmod(F.xxhash64(x), F.lit(BITS - len(own))).cast("int")
    bit = lambda x: shared(x) if places is None else F.coalesce(F.nullif(F.array_position(places, x).cast("int"), F.lit(0)) - 1, shared(x))
    none = F.lit(0).cast("long")

    def word(k: int) -> Column:
        one = lambda seen, x: seen.bitwiseOR(F.when(F.floor(x / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), x % 64)).otherwise(none))
        return F.aggregate("bits", none, one).alias(f"word_{k}")

    bits = sets.select("id", F.col("weight").cast("long").alias("weight"), F.transform("items", bit).alias("bits"))
    return bits.select("id", "weight", *[word(k) for k in range(BITS // 64)])


def _near(num: int, den: int):
    """A function of one pair of blocks: the ids of the pairs whose signatures leave them a chance."""

    def of(block: pa.Table) -> pa.Table:
        words = [block[f"word_{k}"].to_numpy().view(np.uint64) for k in range(BITS // 64)]
        weight = block["weight"].to_numpy().astype(np.int64) * num
        left, right = (np.flatnonzero(block["side"].to_numpy() == k) for k in (0, 1))
        own = not len(right)  # a block with itself
        right = left if own else right
        theirs, reach = [w[right] for w in words], weight[right]
        found = []
        for start in range(0, len(left), STRIP):
            strip, after = left[start : start + STRIP], start if own else 0
            apart = sum(np.bitwise_count(w[strip][:, None] ^ t[None, after:]) for w, t in zip(words, theirs))
            # the widest reach of the strip first, in one byte a pair, then each pair's own
            widest = min(int(weight[strip].max() + reach.max()) // den, 255)
            x, y = np.nonzero(apart <= np.uint8(widest))
            y += after
            kept = apart[x, y - after].astype(np.int64) * den <= weight[strip[x]] + reach[y]
            if own:
                kept &= x + start < y
            found.append((strip[x[kept]], right[y[kept]]))
        x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        ids = block["id"].combine_chunks()
        return pa.table({"x": ids.take(pa.array(x)), "y": ids.take(pa.array(y))})

    return of


def near(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: each pair of the sets (id, items: distinct, weight: a whole number) once whose signatures don't rule out
    that at most num / den of their weights' sum are items that only one of them has. Ids that repeat must be gone before."""
    n = sets.count()
    signed, blocks = _signed(sets, n), max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # block m meets each block n >= m: on the left of (m, n), on the right of (n, m)
    met = signed.withColumn("_m", own).withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(*signed.columns, F.least("_m", "_n").alias("_i"), F.greatest("_m", "_n").alias("_j"), (F.col("_m") > F.col("_n")).cast("int").alias("side"))
    kind = sets.schema["id"].dataType
    dealt = met.repartition(blocks * (blocks + 1) // 2, "_i", "_j").groupBy("_i", "_j")
    pairs = dealt.applyInArrow(_near(num, den), T.StructType([T.StructField("x", kind), T.StructField("y", kind)]))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _counted(pairs: DataFrame, items_a: Column, items_b: Column, num: int, den: int) -> DataFrame:
    def of(s: Column) -> Column:
        common = F.size(F.array_intersect(s["a"], s["b"]))
        return F.struct(common.alias("n_common"), (F.size(s["a"]) + F.size(s["b"]) - common).alias("n_all"))

    counted = pairs.select("a", "b", let(F.struct(items_a.alias("a"), items_b.alias("b")), of).alias("n")).select("a", "b", "n.n_common", "n.n_all")
    return counted.where(den * F.col("n_common") >= num * F.col("n_all"))


def candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b), a < b: each pair of sets that is counted out for a similarity of num / den."""
    # similar sets have at most (den - num) / (den + num) of their sizes' sum apart
    return near(sets.select("id", "items", F.size("items").alias("weight")).where("weight > 0"), den - num, den + num)


def similar_sets(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, n_common, n_all) of all pairs of sets (id, items: distinct) whose similarity n_common / n_all is num / den or more.
    Sets without items have no pairs; ids that repeat must be gone before."""
    a, b = (sets.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab")
    return _counted(candidates(sets, num, den).join(a, "a").join(b, "b"), F.col("items_a"), F.col("items_b"), num, den)


def candidate_counts(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(id, n_candidates): with how many others each set is counted out, the measure of what the filter leaves."""
    pairs = candidates(sets, num, den)
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_candidates"))


def similar_texts(names: DataFrame, text: str, percent: int, q: int = 3) -> DataFrame:
    """(a, b, n_common, n_all) of all pairs of different texts whose q-grams are similar by `percent` of a hundred or more."""
    each = settled(names.select(F.col(text).alias("id")).where("id IS NOT NULL").distinct())
    pairs = candidates(each.withColumn("items", grams(F.col("id"), q)), percent, 100)
    return _counted(pairs, grams(F.col("a"), q), grams(F.col("b"), q), percent, 100)


def alike_texts(names: DataFrame, text: str, percent: int, score) -> DataFrame:
    """(a, b, score) of all pairs of different texts that `score`, a ratio of matching characters (twice the matched over all),
    gives `percent` of a hundred or more. No such ratio exceeds that of the characters' multisets, so the
    signatures of these are joined first. It takes no more edits than the characters that it leaves unmatched, either; the score is
    worked out for what that leaves."""
    each = settled(names.select(F.col(text).alias("id")).where("id IS NOT NULL AND id <> ''").distinct())
    pairs = candidates(each.withColumn("items", letters(F.col("id"))), percent, 200 - percent)
    unmatched = F.floor((100 - percent) * (F.length("a") + F.length("b")) / 100).cast("int")
    pairs = pairs.where(F.call_function("levenshtein", F.col("a"), F.col("b"), unmatched) >= 0)
    return pairs.select("a", "b", score(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= percent / 100)
