"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton reads all items, each from the start state, and then holds every run of words that any item holds. Training
texts stream through it word by word: a state and a length say how long the longest run is that ends at the word and lies
in some item. Where the length reaches WINDOW, the last WINDOW words are a window of an item; an item of fewer words is one
window. Words inside any occurrence are hit. Which items a window belongs to is kept with the state of that window.

A batch's words stream in many lanes at once, as arrays: lanes begin WINDOW - 1 words early, which is enough to know every
window that ends in them, and every text begins at the start state. Words are looked up by a 64-bit hash, and the words of
all hits are compared byte by byte, so no hit rests on a hash.

Items are dealt to blocks of BLOCK_WORDS words (long items in pieces that overlap by a window), each block is built in a task
and sent to the tasks that read the texts; that bounds what is broadcast at about 100 bytes a word of a block, whatever the
number of items. Texts pass the blocks one after the other, with what was found so far.

Null and empty texts and items have no words: nothing is hit, no window belongs to them. Repeated items of one id count once,
repeated texts are searched one by one. Items without an id mark words but aren't listed. Very long texts are searched whole,
four megabytes or one text at a time. Empty tables give no rows, an empty benchmark no hits. Other columns stay, whatever their
names; the result is one struct column.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import staged
from lanewise.llm.words import Words, mix, slices

WINDOW = 10
#: Words of a block of items and of a piece of one item, and the bytes of a word that count as one.
BLOCK_WORDS, PIECE_WORDS, WORD_BYTES = 500_000, 50_000, 16
#: Bytes of text that are searched at a time, and the words that a lane has of its own.
SLICE, LANE = 4 << 20, 96
#: Limits of decontaminated(): a text with a hit run of more words, or with more hits in a hundred words, goes as a whole.
MAX_RUN, MAX_PERCENT = 200, 50

#: Bytes that part words once capitals are small: all of ASCII but digits and small letters.
_PARTS = np.array([b < 128 and not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A) for b in range(256)])
_SMALL = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "n_words", "start", "stop")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)), T.StructField("items", T.ArrayType(T.StringType()))])


def _words(column: pa.Array) -> Iterator[Words]:
    return slices(column, SLICE, _PARTS, lambda data: _SMALL[data])


class Table:
    """A fixed map from 64-bit keys to numbers of 0 or more, looked up for whole arrays at a time; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, rest = mix(keys) & self.mask, np.arange(len(keys))
        while len(rest):
            free = self.values[slot[rest]] < 0
            _, first = np.unique(slot[rest[free]], return_index=True)
            placed = rest[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            rest = np.setdiff1d(rest, placed, assume_unique=True)
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = mix(keys) & self.mask
        out = self.values[slot]
        on = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(on):
            slot[on] = (slot[on] + np.uint64(1)) & self.mask
            out[on] = self.values[slot[on]]
            on = on[(out[on] >= 0) & (self.keys[slot[on]] != keys[on])]
        return out


class Automaton:
    """The generalised suffix automaton of word sequences (item, words as bytes), for streaming texts through."""

    def __init__(self, sequences: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        code: dict[bytes, int] = {}
        coded = [(item, [code.setdefault(w, len(code)) for w in words]) for item, words in sequences]
        self.words = list(code)
        link, length, out = [-1], [0], [{}]

        def state(n: int, edges: dict[int, int], towards: int) -> int:
            link.append(towards), length.append(n), out.append(edges)
            return len(link) - 1

        def split(p: int, c: int) -> int:
            """The state of the run that p's longest run and c give, split off from a state that holds longer ones, too."""
            q = out[p][c]
            if length[q] == length[p] + 1:
                return q
            own = state(length[p] + 1, dict(out[q]), link[q])
            link[q] = own
            while p >= 0 and out[p].get(c) == q:
                out[p][c] = own
                p = link[p]
            return own

        for _, codes in coded:
            last = 0
            for c in codes:
                if c in out[last]:
                    last = split(last, c)
                    continue
                new, p = state(length[last] + 1, {}, 0), last
                while p >= 0 and c not in out[p]:
                    out[p][c] = new
                    p = link[p]
                link[new] = split(p, c) if p >= 0 else 0
                last = new
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        starts = np.repeat(np.arange(len(out)), [len(e) for e in out]).astype(np.uint64)
        over = np.fromiter((c for e in out for c in e), np.uint64, len(starts))
        self.edges = Table(starts << np.uint64(32) | over, np.fromiter((t for e in out for t in e.values()), np.int32, len(starts)))
        column = pa.array([b" ".join(self.words).decode()])
        self.vocabulary = Table(next(_words(column)).hashes() if self.words else np.zeros(0, np.uint64), np.arange(len(self.words), dtype=np.int32))
        self._windows(coded, link, length, out)

    def _windows(self, coded, link, length, out) -> None:
        """Numbers the windows: a state's window of `window` words, and the short items that are runs of a state."""
        number: dict[tuple[int, int], int] = {}
        owners: list[set[str]] = []
        for item, codes in coded:
            at, size = 0, min(self.window, len(codes))
            for k, c in enumerate(codes):
                at = out[at][c]
                if k + 1 >= size:
                    while length[link[at]] >= size:
                        at = link[at]
                    n = number.setdefault((at, size), len(number))
                    if n == len(owners):
                        owners.append(set())
                    if item is not None:
                        owners[n].add(item)
        self.owners = [sorted(o) for o in owners]
        self.long, short = np.full(len(link), -1, np.int32), {}
        for (at, size), n in number.items():
            if size == self.window:
                self.long[at] = n
            else:
                short.setdefault(at, []).append((size, n))
        # states in order of length: a state's link comes before it
        self.lower, self.anchor = np.full(len(link), -1, np.int32), np.arange(len(link), dtype=np.int32)
        for at in np.argsort(self.length, kind="stable").tolist()[1:]:
            up = link[at]
            self.lower[at] = up if up in short else self.lower[up]
            if length[up] >= self.window:
                self.anchor[at] = self.anchor[up]
        self.has_short = np.array([at in short for at in range(len(link))])
        held = [short.get(at, ()) for at in range(len(link))]
        self.short_at = np.concatenate([[0], np.cumsum([len(h) for h in held])])
        self.short_size = np.array([s for h in held for s, _ in h], np.int64)
        self.short_number = np.array([n for h in held for _, n in h], np.int64)

    def stream(self, codes: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its state and the length of the longest run that ends there (window - 1 words of context at least).
        codes: words by number, -1 for others; fresh: the words that begin a text."""
        n, early = len(codes), self.window - 1
        states, lengths = np.zeros(n, np.int32), np.zeros(n, np.int32)
        begin = np.arange(0, n, LANE)
        at, run = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        for step in range(-early, LANE):
            pos = begin + step
            if step < 0:
                pos = np.where(pos < 0, n, pos)
            live = np.flatnonzero(pos < n)
            pos = pos[live]
            code = codes[pos]
            reset = fresh[pos] | (code < 0)
            at[live[reset]], run[live[reset]] = 0, 0
            live, pos, code = live[code >= 0], pos[code >= 0], code[code >= 0]
            todo, word = live, code.astype(np.uint64)
            while len(todo):
                here = at[todo]
                to = self.edges.find(here.astype(np.uint64) << np.uint64(32) | word)
                good = to >= 0
                at[todo[good]] = to[good]
                run[todo[good]] += 1
                bad = ~good & (here > 0)
                stuck = todo[~good & (here == 0)]
                run[stuck] = 0
                todo, word = todo[bad], word[bad]
                at[todo] = self.link[at[todo]]
                run[todo] = self.length[at[todo]]
            if step >= 0:
                states[pos], lengths[pos] = at[live], run[live]
        return states, lengths

    def windows(self, states: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences of windows: last word, number of words, number of the window."""
        last = np.flatnonzero(lengths >= self.window)
        ends, sizes, numbers = [last], [np.full(len(last), self.window)], [self.long[self.anchor[states[last]]]]
        at = np.where(self.has_short[states], states, self.lower[states])
        on = np.flatnonzero(at >= 0)
        while len(on):
            here = at[on]
            n = self.short_at[here + 1] - self.short_at[here]
            which = np.repeat(self.short_at[here], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            end = np.repeat(on, n)
            held = self.short_size[which] <= lengths[end]
            ends.append(end[held]), sizes.append(self.short_size[which[held]]), numbers.append(self.short_number[which[held]])
            at[on] = self.lower[here]
            on = on[at[on] >= 0]
        return np.concatenate(ends), np.concatenate(sizes), np.concatenate(numbers)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hit words of a slice (a mask), and distinct (row, window) pairs of the occurrences."""
        codes = self.vocabulary.find(words.hashes())
        fresh = np.ones(len(codes), bool)
        fresh[1:] = words.row[1:] != words.row[:-1]
        raw = words.data.tobytes()
        while True:
            end, size, number = self.windows(*self.stream(codes, fresh))
            depth = np.zeros(len(codes) + 1, np.int64)
            np.add.at(depth, end - size + 1, 1)
            np.add.at(depth, end + 1, -1)
            hit = np.cumsum(depth[:-1]) > 0
            wrong = [k for k in np.flatnonzero(hit).tolist() if raw[words.starts[k] : words.ends[k]] != self.words[codes[k]]]
            if not wrong:
                break
            codes[wrong] = -1  # another word of the same hash
        pairs = np.unique(words.row[end] * np.int64(len(self.owners) + 1) + number)
        return hit, pairs // (len(self.owners) + 1), pairs % (len(self.owners) + 1)


def _runs(hit: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of every run of hit words of one row."""
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~(hit[:-1] & (row[1:] == row[:-1]))
    end[:-1] &= ~(hit[1:] & (row[1:] == row[:-1]))
    return np.flatnonzero(begin), np.flatnonzero(end)


def _searched(automaton: Automaton, column: pa.Array, before: list[dict] | None) -> list[tuple]:
    """For each text the values of FOUND, those of `before` included."""
    out = []
    for w in _words(column):
        hit, at, number = automaton.search(w)
        counts = w.counts()
        first = np.cumsum(counts) - counts
        items: list[set[str]] = [set() for _ in range(w.rows)]
        for r, k in zip(at.tolist(), number.tolist()):
            items[r].update(automaton.owners[k])
        for r in range(w.rows) if before else ():
            for s in before[w.lo + r]["spans"]:
                hit[first[r] + s["first_word"] : first[r] + s["first_word"] + s["n_words"]] = True
            items[r].update(before[w.lo + r]["items"])
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        a, b = _runs(hit, w.row)
        row = w.row[a]
        start, stop = chars[w.starts[a]] - chars[w.offsets[row]], chars[w.ends[b]] - chars[w.offsets[row]]
        spans: list[list] = [[] for _ in range(w.rows)]
        for r, *span in zip(row.tolist(), (a - first[row]).tolist(), (b - a + 1).tolist(), start.tolist(), stop.tolist()):
            spans[r].append(span)
        n_hit = np.bincount(w.row[hit], minlength=w.rows)
        out += zip(counts.tolist(), n_hit.tolist(), spans, [sorted(i) for i in items])
    return out


_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([(f.name, pa.int64()) for f in _SPAN]))), ("items", pa.list_(pa.string()))]
)


def blocks(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(block, automaton: pickled) of the items, written once. Items go to blocks by the words before them, pieces by pieces."""
    named = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    piece = min(PIECE_WORDS, block_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _words(batch.column(1)):
                texts, counts = w.texts(), w.counts()
                for r, (first, n) in enumerate(zip((np.cumsum(counts) - counts).tolist(), counts.tolist())):
                    parts = [texts[first + lo : first + min(lo + piece + window - 1, n)] for lo in range(0, max(1, n - window + 1), piece)] if n else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[w.lo + r].as_py()] * len(parts), pa.string()), pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int64())],
                        names=["item", "words", "n"],
                    )

    pieces = staged(named.mapInArrow(cut, "item string, words binary, n bigint"), "pieces")
    weight = F.greatest("n", F.octet_length("words") / WORD_BYTES)  # so that long words don't make a block larger, either
    n_blocks = max(1, -(-int(pieces.agg(F.sum(weight)).first()[0] or 0) // block_words))
    dealt = pieces.distinct().withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))

    def built(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item").to_pylist(), table.column("words").to_pylist()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        machine = Automaton([(item, words.split(b" ")) for item, words in rows], window)
        return pa.table({"block": table.column("block").slice(0, 1), "automaton": pa.array([pickle.dumps(machine)], pa.binary())})

    return staged(dealt.groupBy("block").applyInArrow(built, "block bigint, automaton binary"), "automata")


def matched(docs: DataFrame, items: DataFrame, text: str = "text", into: str = "matches", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct of FOUND: n_words, n_hit, spans (runs of hit words, with their places in words and in code points) and the
    sorted ids, as strings, of the items whose windows occur."""
    automata = blocks(items, item_key, item_text, window, block_words)
    names = sorted(r.block for r in automata.select("block").collect())
    if not names:
        zero = F.lit(None)
        schema = FOUND.simpleString()
        empty = F.named_struct(F.lit("n_words"), zero, F.lit("n_hit"), zero, F.lit("spans"), zero, F.lit("items"), zero).cast(schema)
        return _measured(docs.withColumn(into, empty), Automaton([], window), text, into, False)
    out = docs
    for k, name in enumerate(names):
        machine = automata.where(F.col("block") == name).first().automaton
        out = _measured(staged(out, "searched") if k else out, docs.sparkSession.sparkContext.broadcast(machine), text, into, k > 0)
    return out


def _measured(docs: DataFrame, machine, text: str, into: str, again: bool) -> DataFrame:
    kept = [f for f in docs.schema if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, FOUND)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = machine if isinstance(machine, Automaton) else pickle.loads(machine.value)
        for batch in batches:
            at = batch.schema.get_field_index
            before = batch.column(at(into)).to_pylist() if again else None
            found = _searched(automaton, batch.column(at(text)), before)
            rows = [{"n_words": n, "n_hit": h, "spans": [dict(zip(_SPAN.names, s)) for s in spans], "items": items} for n, h, spans, items in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(at(n)) for n in names), pa.array(rows, _ARROW)], names=[*names, into])

    return docs.mapInArrow(run, schema)


def without(text: Column, spans: Column) -> Column:
    """The text without the spans: what lies before the first, between and after the last, joined."""
    step = F.aggregate(
        spans,
        F.struct(F.lit("").cast("string").alias("kept"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.struct(F.concat(s["kept"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))).alias("kept"), x["stop"].alias("at")),
        lambda s: F.concat(s["kept"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, step).otherwise(text)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", max_run: int = MAX_RUN, max_percent: int = MAX_PERCENT, **more) -> DataFrame:
    """docs without what they share with the items: texts with a hit run of more than max_run words, or with more than max_percent of
    their words hit, go as a whole; of the others the hit spans are cut out."""
    into = "lanewise_matches"
    found = matched(docs, items, text, into, **more)
    m = F.col(into)
    long = F.exists(m["spans"], lambda s: s["n_words"] > max_run)
    wide = 100 * m["n_hit"] > max_percent * m["n_words"]
    return found.where(~long & ~wide).select(*[without(F.col(c), m["spans"]).alias(c) if c == text else F.col(c) for c in docs.columns])
