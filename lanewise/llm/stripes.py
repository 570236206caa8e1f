"""Source divergence audit: how far the word distributions of a language's sources lie apart, with in-mapper stripes.

Each task folds whole documents into stripes, term -> (documents with the term, count in each source), in hash tables. When
they hold SPILL counts they are spilled as rows and the tables start anew. Stripes are dealt and sorted by (language, term)
and merged in one pass along the sorted rows; since a task sends a term at most once a spill, frequent terms aren't hot. Of
a language's terms those in at least MIN_DOCS of its documents are kept. Every merged stripe then gives its divergences
directly: smoothed shares in whole numbers of SCALE, their differences between every two sources (summed up per task's
batch, block of sources by block, before the shuffle), and by how much a source's share exceeds the language's.

Null texts, languages and sources count as ''. A text without terms still makes its source occur, by a marker stripe of the
empty term; a language without kept terms has divergences of 0. Repeated rows count each time. Very long texts are folded
whole; a task's tables hold SPILL counts and one document more. Ties of values go by the items' UTF-8 bytes. An empty table
gives no rows. Other columns than the three named are not read, whatever their names.

Sources of a language meet in one row (name and total each), as all their pairs are the result; the terms are not limited.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import staged
from lanewise.operators.core import BROADCAST_ROWS

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Counts (a term of a source, or of a language's documents) that a task's tables hold before they are spilled.
SPILL = 600_000
#: Sources whose differences to all others are held at a time, and shares (terms times sources) worked on at a time.
BLOCK, CELLS = 256, 1 << 20

#: Small ASCII letters and all non-ASCII bytes make terms, capitals as small letters; any other byte parts them.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8, in order."""
    return text.encode().translate(_FOLD).split(b" ") if text else []


_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_STRIPE_DDL = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"


def _stripes(lang: str, df: Counter, counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """The stripes of a language: the marker with its sources, then one a term."""
    names = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([0]), pa.array([names]), pa.array([[0] * len(names)], pa.list_(pa.int64()))], schema=_STRIPE)
    words = list(df)
    place = {w: k for k, w in enumerate(words)}
    term = np.fromiter((place[w] for c in counts.values() for w in c), np.int64)
    source = np.repeat(np.arange(len(names)), [len(c) for c in counts.values()])
    n = np.fromiter((n for c in counts.values() for n in c.values()), np.int64)
    order = np.argsort(term, kind="stable")
    term, source, n = term[order], source[order], n[order]
    at = np.searchsorted(term, np.arange(len(words) + 1))
    for lo in range(0, len(words), 4096):
        hi = min(lo + 4096, len(words))
        a, b = at[lo], at[hi]
        offsets = pa.array((at[lo : hi + 1] - a).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (hi - lo)),
                pa.array([w.decode() for w in words[lo:hi]]),
                pa.array([df[w] for w in words[lo:hi]], pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(names, pa.string()).take(pa.array(source[a:b]))),
                pa.ListArray.from_arrays(offsets, pa.array(n[a:b])),
            ],
            schema=_STRIPE,
        )


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents (lang, source, text) to the task's stripes, spill by spill."""
    df: dict[str, Counter] = defaultdict(Counter)
    counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

    def spilled() -> Iterator[pa.RecordBatch]:
        for lang in counts:
            yield from _stripes(lang, df[lang], counts[lang])
        df.clear(), counts.clear()

    held = 0
    for batch in batches:
        for row in range(batch.num_rows):
            lang, source, text = (batch.column(k)[row].as_py() for k in range(3))
            found, seen, stripe = terms(text), df[lang], counts[lang][source]
            before = len(stripe) + len(seen)
            stripe.update(found)
            stripe.pop(b"", None)
            seen.update(set(found))
            seen.pop(b"", None)
            held += len(stripe) + len(seen) - before
            if held >= SPILL:
                yield from spilled()
                held = 0
    yield from spilled()


def _merged(table: pa.Table) -> pa.Table:
    """A table of stripes, sorted by (lang, term), with those of one key as one: counts add up, sources ascend."""
    table = table.combine_chunks()
    lang, term = (np.asarray(table.column(c).combine_chunks().dictionary_encode().indices) for c in ("lang", "term"))
    new = np.ones(table.num_rows, bool)
    new[1:] = (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])
    first, key = np.flatnonzero(new), np.cumsum(new) - 1
    sources, counts = table.column("sources").combine_chunks(), table.column("counts").combine_chunks()
    names = sources.flatten().dictionary_encode()
    cell = np.repeat(key, np.asarray(sources.value_lengths())) * max(1, len(names.dictionary)) + np.asarray(names.indices, np.int64)
    cell, inverse = np.unique(cell, return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, inverse, np.asarray(counts.flatten()))
    offsets = pa.array(np.searchsorted(cell, np.arange(len(first) + 1) * max(1, len(names.dictionary))).astype(np.int32))
    which = names.dictionary.take(pa.array(cell % max(1, len(names.dictionary))))
    df = np.add.reduceat(np.asarray(table.column("df")), first)
    keys = table.select(["lang", "term"]).take(pa.array(first))
    return pa.table([*keys.columns, pa.array(df), pa.ListArray.from_arrays(offsets, which), pa.ListArray.from_arrays(offsets, pa.array(total))], schema=_STRIPE)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stripes, one a key; the last key of a batch waits, merged, for the next one."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows:
            found = _merged(pa.concat_tables([*held, pa.Table.from_batches([batch]).cast(_STRIPE)]))
            held = [found.slice(found.num_rows - 1)]
            yield from found.slice(0, found.num_rows - 1).to_batches()
    for rest in held:
        yield from rest.to_batches()


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / whole), exactly, for counts up to whole: long division by thousands keeps to 64 bits."""
    out, rest = np.divmod(counts, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _dense(sources: pa.ListArray, counts: pa.ListArray, names: dict[str, int]) -> np.ndarray:
    """Terms by sources: the counts, 0 where a stripe has none."""
    out = np.zeros((len(sources), len(names)), np.int64)
    row = np.repeat(np.arange(len(sources)), np.asarray(sources.value_lengths()))
    out[row, [names[s] for s in sources.flatten().to_pylist()]] = np.asarray(counts.flatten())
    return out


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _emitted(lang: str, source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], schema=_OUT)


def _divergences(lang: str, n_terms: int, groups: list[dict], stripes: pa.Table) -> Iterator[pa.RecordBatch]:
    """What stripes of one language add to the differences of its sources, and where a source's share exceeds the language's."""
    names = pa.array([g["source"] for g in groups], pa.string())
    place = {g["source"]: k for k, g in enumerate(groups)}
    whole = np.array([g["total"] for g in groups], np.int64) + SMOOTH * n_terms
    step = max(1, CELLS // max(1, len(groups)))
    parts = [stripes.slice(lo, step).combine_chunks() for lo in range(0, stripes.num_rows, step)]
    dense = lambda t: _dense(t.column("sources").combine_chunks(), t.column("counts").combine_chunks(), place)
    for lo in range(0, len(groups), BLOCK):
        hi = min(lo + BLOCK, len(groups))
        apart = np.zeros((hi - lo, len(groups)), np.int64)
        for t in parts if n_terms else []:
            p = shares(dense(t) + SMOOTH, whole)
            for a in range(lo, hi):
                apart[a - lo] += np.abs(p - p[:, a : a + 1]).sum(axis=0)
        a, b = np.nonzero(np.arange(lo, hi)[:, None] != np.arange(len(groups)))
        yield _emitted(lang, names.take(pa.array(a + lo)), "pair", names.take(pa.array(b)), apart[a, b])
    for t in parts if n_terms else []:
        counts = dense(t)
        q = shares(counts.sum(axis=1) + SMOOTH, np.int64(whole.sum() - SMOOTH * n_terms * (len(groups) - 1)))
        over = shares(counts + SMOOTH, whole) - q[:, None]
        row, group = np.nonzero((counts > 0) & (over > 0))
        yield _emitted(lang, names.take(pa.array(group)), "term", t.column("term").combine_chunks().take(pa.array(row)), over[row, group])


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged stripes with their language's n_terms and groups, to divergences. A marker stripe gives all pairs with 0."""
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        for lang in whole.column("lang").unique().to_pylist():
            own = whole.filter(pa.compute.equal(whole.column("lang"), lang))
            n_terms, groups = own.column("n_terms")[0].as_py(), own.column("groups")[0].as_py()
            real = own.filter(pa.compute.not_equal(own.column("term"), ""))
            if real.num_rows < own.num_rows:
                yield from _divergences(lang, 0, groups, own.slice(0, 0))
            if real.num_rows:
                yield from _divergences(lang, n_terms, groups, real)


def stripes(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """The merged stripes of the kept terms, and a marker of the empty term with all sources of each language, written once:
    lang, term, df, sources, counts."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    dealt = plain.mapInArrow(fold, _STRIPE_DDL).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return staged(dealt.mapInArrow(merge, _STRIPE_DDL).where((F.col("df") >= min_docs) | (F.col("term") == "")), "stripes")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair`, the distance to every other source of the language; part `term`, the
    `top` kept terms that the source has more of than the language."""
    kept = stripes(docs, text, lang, source, min_docs)
    cells = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("c"))
    totals = cells.groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    groups = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("groups"))
    n_terms = kept.groupBy("lang").agg((F.count("*") - 1).alias("n_terms"))
    side = groups.join(n_terms, "lang")
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # a name and a number for each group
        side = F.broadcast(side)
    known = kept.join(side, "lang").select("lang", "term", "sources", "counts", "n_terms", "groups")
    found = staged(known.mapInArrow(emit, "lang string, source string, part string, item string, value bigint"), "divergences")
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    over = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(w)).unionByName(over)
