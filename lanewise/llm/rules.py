"""Quality rules with adaptive thresholds.

Each document is measured once (words, symbols, repeated lines and word windows). The measures of every language and
source go into mergeable quantile sketches: counts on a log-linear grid of integers, which add up exactly in any order
and hold at most `GRID_CELLS` cells a measure. A rate's fence comes from the tail of its sketch, the quantiles TAIL: where two
neighbouring ones lie a factor of JUMP apart, as where a part of the texts is of another kind, the fence stands between them,
else at the last. Quantiles are compared with the rate of one event in a text of the group's mean length added, below
which rates say nothing. Word length has two fences, beyond its deciles by REACH times their distance from the median. A source's
fences are weighed with its language's and these with all rows', by how many rows each has, so small groups lean on wider
ones without a switch, and no fence is a fixed number. A rate is held against its fence with the tolerance that counts of
that size have by chance: REACH standard deviations of a Poisson count of as many events as the fence allows that text.

Null texts and texts without words have no words, fail the base rule and are not kept. Null languages and sources are
groups of their own. Repeated rows are measured and judged one by one, ties of values share a cell. Very long texts are
measured whole. An empty table gives none. Only the named columns are read; others, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanewise.llm.common import staged
from lanewise.llm.words import mix, segment_hash, shingles, slices

METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3
#: Rows that the wider group's fences count for when a group's own are weighed with them.
PRIOR = 200
#: Distances between median and decile that a fence of word length lies beyond the decile; standard deviations of the tolerance.
REACH = 3
#: Quantiles, in thousandths, that a rate's fence is taken from, and the factor between two that parts kinds of text.
TAIL, JUMP = (700, 900, 950, 980, 990, 995), 8
#: Rate -> numerator, denominator, marks that one event leaves (a word window that comes again: two windows of words).
RATES = {"symbol_rate": ("n_symbols", "n_words", 1), "dup_line_rate": ("n_dup_lines", "n_lines", 1), "repeat_rate": ("n_repeat_words", "n_words", 2 * WINDOW)}
#: Rates are counted per SCALE; word length, in hundredths, has two fences.
SCALE, LENGTH_SCALE = 1000, 100
MEASURES = (*RATES, "word_length")
#: Values below 2**EXACT_BITS have cells of their own, larger ones share their leading EXACT_BITS bits.
EXACT_BITS = 6
GRID_CELLS = 2**EXACT_BITS + (63 - EXACT_BITS) * 2 ** (EXACT_BITS - 1)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _measures(column: pa.Array) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {m: [] for m in METRICS}
    for w in slices(column):
        n = w.rows
        word_bytes = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(word_bytes, w.starts, 1)
        np.add.at(word_bytes, w.ends, -1)
        inside = np.cumsum(word_bytes[:-1]).astype(bool)
        parts["n_words"].append(w.counts())
        parts["word_chars"].append(w.per_row(inside & ((w.data & 0xC0) != 0x80)))
        parts["n_symbols"].append(w.per_row(_IS_SYMBOL[w.data]))
        cuts = np.flatnonzero(w.data == 0x0A)
        begins = np.union1d(w.offsets[:-1], cuts + 1)
        begins = begins[begins < len(w.data)]
        ends = np.append(begins[1:], len(w.data))
        ends = ends - ((ends > begins) & (w.data[np.maximum(ends, 1) - 1] == 0x0A)) if len(begins) else ends
        worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
        begins, ends = begins[worded], ends[worded]
        row = np.searchsorted(w.offsets[1:], begins, "right")
        lines = np.bincount(row, minlength=n)
        keys = mix(segment_hash(w.data, begins, ends) + mix(row.astype(np.uint64)))
        _, first = np.unique(keys, return_index=True)
        parts["n_lines"].append(lines)
        parts["n_dup_lines"].append(lines - np.bincount(row[first], minlength=n))
        h, row, first = shingles(w, WINDOW)
        covered = np.zeros(len(w.row), bool)
        if len(h):
            _, inverse, count = np.unique(mix(h + mix(row.astype(np.uint64))), return_inverse=True, return_counts=True)
            again = first[count[inverse] > 1]
            for k in range(WINDOW):
                covered[again + k] = True
        parts["n_repeat_words"].append(np.bincount(w.row[covered], minlength=n))
    return {m: np.concatenate(p).astype(np.int64) if p else np.zeros(0, np.int64) for m, p in parts.items()}


def measure(docs: DataFrame, text: str = "text", into: str = "measures") -> DataFrame:
    """docs with a struct of METRICS in place of the text, or next to it where `into` isn't the text's name."""
    schema = T.StructType([f for f in docs.schema if f.name != into])
    struct = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])
    schema = T.StructType([*schema, T.StructField(into, struct)])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _measures(batch.column(batch.schema.get_field_index(text)))
            cell = pa.StructArray.from_arrays([pa.array(found[m]) for m in METRICS], names=list(METRICS))
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, cell], names=[*names, into])

    return docs.mapInArrow(run, schema)


def grid(value: Column) -> Column:
    """The grid cell of a value of 0 or more, named by its least member."""
    shift = F.greatest(F.length(F.bin(value)) - EXACT_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def cell_top(cell: Column) -> Column:
    """The greatest member of a grid cell."""
    return cell + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(cell)) - EXACT_BITS, F.lit(0))) - 1


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rates(m: Column) -> dict[str, Column]:
    share = lambda over, scale, under: F.when(m[under] > 0, F.floor(m[over] * scale / m[under])).otherwise(0).cast("long")
    return {k: share(over, SCALE, under) for k, (over, under, _) in RATES.items()} | {"word_length": share("word_chars", LENGTH_SCALE, "n_words")}


def sketches(measured: DataFrame, groups: tuple[str, str] = ("lang", "source"), into: str = "measures") -> DataFrame:
    """The sketch of every group and measure: lang, source, measure, cell, n, under (words or lines that the rates are of).
    Documents that fail the base rule don't count."""
    m = F.col(into)
    under = {k: m[u] for k, (_, u, _) in RATES.items()} | {"word_length": m["n_words"]}
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), grid(v).alias("cell"), under[k].alias("under")) for k, v in rates(m).items()])
    lang, source = (F.col(g).cast("string") for g in groups)
    return (
        measured.where(~base_failed(m))
        .select(lang.alias("lang"), source.alias("source"), F.explode(cells).alias("c"))
        .groupBy("lang", "source", F.col("c.measure").alias("measure"), F.col("c.cell").alias("cell"))
        .agg(F.count("*").alias("n"), F.sum("c.under").alias("under"))
    )


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """Sketches merged over all but the given groups: their counts add up."""
    return sketch.groupBy(*by, "measure", "cell").agg(F.sum("n").alias("n"), F.sum("under").alias("under"))


#: Column -> thousandths of the rows at or below it.
DECILES = {"low": 100, "mid": 500, "high": 900}
LEVELS = {m: {f"q{t}": t for t in TAIL} for m in RATES} | {"word_length": DECILES}


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """One row a group: n (its rows), <rate>_q700 and so on, word_length_low, _mid and _high, and <rate>_unit, the rate of one event in a
    text of mean length."""
    w = Window.partitionBy(*by, "measure")
    cells = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda name, part: F.min(F.when((F.col("measure") == name) & (1000 * F.col("upto") >= part * F.col("total")), F.col("cell")))
    found = [at(m, t).alias(f"{m}_{q}") for m, levels in LEVELS.items() for q, t in levels.items()]
    sums = [F.sum(F.when(F.col("measure") == m, F.col("under"))).alias(f"{m}_under") for m in RATES]
    groups = cells.groupBy(*by).agg(F.max("total").alias("n"), *found, *sums)
    return groups.select("*", *[F.expr(f"greatest(1, {SCALE * event} * n div {m}_under)").alias(f"{m}_unit") for m, (_, _, event) in RATES.items()])


def fences(sketch: DataFrame, *by: str) -> DataFrame:
    """One row a group: n, <rate>_hi, word_length_hi and word_length_lo, by the group's own sketch."""
    q = quantiles(sketch, *by)
    out = []
    for m in RATES:
        parts = [F.col(f"{m}_q{t}") + F.col(f"{m}_unit") for t in TAIL]
        hi = F.col(f"{m}_q{TAIL[-1]}")
        for lower, upper in reversed(list(zip(parts, parts[1:]))):  # the first gap counts
            hi = F.when(upper >= JUMP * lower, F.floor(F.sqrt((lower * upper).cast("double"))) - F.col(f"{m}_unit")).otherwise(hi)
        out.append(hi.cast("long").alias(f"{m}_hi"))
    low, mid, high = (F.col(f"word_length_{d}") for d in DECILES)
    high = cell_top(high)
    return q.select(*by, "n", *out, (high + REACH * (high - mid)).alias("word_length_hi"), F.greatest(F.lit(0), low - REACH * (mid - low)).cast("long").alias("word_length_lo"))


FENCES = (*[f"{m}_hi" for m in MEASURES], "word_length_lo")


#: Fences are broadcast up to so many groups (under 150 bytes each), beyond that joined by a shuffle.
BROADCAST_GROUPS = 20_000


def thresholds(sketch: DataFrame) -> DataFrame:
    """The fences that hold for each language and source, FENCES, written once."""
    own, lang, every = fences(sketch, "lang", "source"), fences(merged(sketch, "lang"), "lang"), fences(merged(sketch))
    joined = (
        own.alias("o")
        .join(lang.alias("l"), F.col("o.lang").eqNullSafe(F.col("l.lang")), "left")
        .join(F.broadcast(every.alias("e")))  # one row
    )
    weighed = lambda n, own_, wide: F.expr(f"({n} * {own_} + {PRIOR} * {wide}) div ({n} + {PRIOR})")
    near = joined.select("o.*", *[weighed("l.n", f"l.{c}", f"e.{c}").alias(f"wide_{c}") for c in FENCES])
    return staged(near.select(F.col("lang").alias("fence_lang"), F.col("source").alias("fence_source"), *[weighed("n", c, f"wide_{c}").alias(c) for c in FENCES]), "fences")


def within(m: Column, side: DataFrame) -> Column:
    """Whether a document's measures hold the fences."""
    length = rates(m)["word_length"]
    held = (length <= side["word_length_hi"]) & (length >= side["word_length_lo"])
    for name, (over, under, event) in RATES.items():
        allowed = side[f"{name}_hi"] * m[under]
        excess = (SCALE * m[over] - allowed).cast("double")
        chance = F.lit(float(SCALE**2 * REACH**2 * event)) * (allowed.cast("double") / F.lit(float(SCALE)) + F.lit(float(event)))
        held = held & ((excess <= 0) | (excess * excess <= chance))
    return held


def judged(measured: DataFrame, fence: DataFrame, groups: tuple[str, str] = ("lang", "source"), into: str = "measures", verdict: str = "kept") -> DataFrame:
    """measured with a boolean `verdict`: the base rule and every fence hold."""
    m = F.col(into)
    small = fence.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    side = F.broadcast(fence) if small else fence
    lang, source = (measured[g].cast("string") for g in groups)
    out = measured.join(side, lang.eqNullSafe(side["fence_lang"]) & source.eqNullSafe(side["fence_source"]), "left")
    keep = [measured[c] for c in measured.columns if c != verdict]
    return out.select(*keep, (~base_failed(m) & F.coalesce(within(m, side), F.lit(False))).alias(verdict))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """One row a document: key, groups, METRICS, base_failed, kept. The text is read once."""
    slim = docs.select(F.col(key), *[F.col(g) for g in groups], F.col(text).alias("measures_text"))
    measured = staged(measure(slim, "measures_text").drop("measures_text"), "measures")
    out = judged(measured, thresholds(sketches(measured, groups)), groups)
    m = F.col("measures")
    return out.select(key, *groups, *[m[x].alias(x) for x in METRICS], base_failed(m).alias("base_failed"), "kept")


def keep_by_rules(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The documents, all their columns, that the rules keep. They are measured once and written with their measures."""
    into, verdict = "lanewise_measures", "lanewise_kept"
    measured = staged(measure(docs, text, into), "measured")
    out = judged(measured, thresholds(sketches(measured, groups, into)), groups, into, verdict)
    return out.where(F.col(verdict)).select(*docs.columns)
