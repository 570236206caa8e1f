"""Near-duplicate classes by BagMinHash.

A document is the multiset of its runs of five words. Each element owns a Poisson process over (weight, time): dyadic
weight blocks [0,1), [1,2), [2,4), ... are the top of the hierarchy, the coin flips that split a block down to unit
weights are the bits of a point's weight coordinate, and a point counts where that coordinate lies below the element's
count. Points fall on random registers; a register keeps its earliest point. Two documents then agree on a register
with probability equal to their weighted Jaccard similarity.

Registers are banded. The texts of a bucket are dealt to SALTS parts; in a part every text is compared with the part's
leader, and the leaders with the first of them, not all with each other, and compared means an exact multiset overlap.
Buckets whose texts still lie in several classes go through a second pass that computes the overlaps of each text outside
the bucket's largest class with all its texts, block by block inside tasks, so a link between different texts isn't lost to
the star shape. No task gets more of a bucket than a part of it, or two blocks of about BLOCK_BYTES.

Null texts and texts without words are nobody's duplicates: each such row is a class of its own. Texts of one to four
words have one element, all their words. Equal texts are one class at once; repeated rows of one key stay rows. Very long
texts are compared whole. Classes don't depend on ties: of equally early points, leaders and sizes one is taken by its hash.
An empty table gives no rows. Columns but key and text are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import drop, staged, tables
from lanewise.llm.words import mix, shingle_bags, slices, unit

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold shares none of 25 bands of 5 registers with probability (1 - 0.8**5)**25 = 5e-5.
BANDS, BAND = 25, 5
REGISTERS = BANDS * BAND
#: Parts of a bucket, and bytes of text in one block of the second pass.
SALTS, BLOCK_BYTES = 256, 4 << 20
#: Rows of a bucket that meet one row of what is known of the bucket.
SALTED = 64
_U = np.uint64
_SIG_SLICE = 2 << 20


def signatures(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (rows x registers, uint64) of bags given as (row, element hash, count), by row. Rows without elements: 0."""
    out = np.zeros((rows, registers), _U)
    weight = np.bincount(row, weights=count, minlength=rows)
    todo = np.flatnonzero(weight > 0)
    slack = 3.0
    while len(todo):
        bound = np.full(rows, 0.0)
        bound[todo] = (np.log(registers) + slack) / weight[todo]
        pick = np.flatnonzero(bound[row] > 0)
        got_row, got_reg, got_time, got_id = _points(row[pick], element[pick], count[pick], bound, registers)
        slot = got_row * registers + got_reg
        order = np.argsort(got_time)[::-1]  # the earliest is written last
        flat, seen = out.reshape(-1), np.zeros(rows * registers, bool)
        flat[slot[order]] = got_id[order]
        seen[slot] = True
        full = seen.reshape(rows, registers).all(axis=1)
        todo = todo[~full[todo]]
        slack *= 4
    return out


def _points(row, element, count, bound, registers):
    """All points of the bags' processes up to each row's bound."""
    level = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)  # blocks 0..level: [0,1), [1,2), [2,4), ...
    n = level + 1
    who = np.repeat(np.arange(len(row)), n)
    block = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    seed = mix(element[who] + block.astype(_U) * _U(0x9E3779B97F4A7C15))
    width = np.where(block <= 1, 1, 1 << np.maximum(block - 1, 0))
    low = np.where(block == 0, 0, width)
    limit, at, most = count[who], row[who], bound[row[who]]
    time, live, step = np.zeros(len(who)), np.arange(len(who)), 0
    found = []
    while len(live):
        step += 1
        bits = mix(seed[live] + _U((step * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)))
        time[live] += -np.log(unit(bits)) / (registers * width[live])
        live, bits = live[time[live] <= most[live]], bits[time[live] <= most[live]]
        more = mix(bits + _U(0x632BE59BD9B4E019))
        coins = low[live] + (mix(more) % width[live].astype(_U)).astype(np.int64)
        inside = coins < limit[live]
        hit = live[inside]
        found.append((at[hit], (more[inside] % _U(registers)).astype(np.int64), time[hit], more[inside]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def _signed(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Registers of each text, and whether it has a word."""
    sigs, some = [np.zeros((0, REGISTERS), _U)], [np.zeros(0, bool)]
    for w in slices(batch, _SIG_SLICE):
        sigs.append(signatures(*shingle_bags(w, SHINGLE), w.rows))
        some.append(w.counts() > 0)
    return np.concatenate(sigs), np.concatenate(some)


def signed(texts: DataFrame) -> DataFrame:
    """(tid, text) -> (tid, buckets: a key for each band of registers), texts with a word only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, some = _signed(batch.column(1))
            keys = np.zeros((len(sig), BANDS), _U)
            for k in range(BAND):
                keys = mix(keys * _U(3) + sig[:, k::BAND])
            keys = mix(keys + np.arange(BANDS, dtype=_U))
            keep = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(keep)),
                    pa.ListArray.from_arrays(np.arange(0, len(keep) * BANDS + 1, BANDS, dtype=np.int32), keys[keep].view(np.int64).reshape(-1)),
                ],
                names=["tid", "buckets"],
            )

    return texts.mapInArrow(run, "tid binary, buckets array<bigint>")


def _bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for w in slices(column):
        row, h, n = shingle_bags(w, SHINGLE)
        at = np.searchsorted(row, np.arange(w.rows + 1))
        out += [(h[a:b], n[a:b]) for a, b in zip(at[:-1], at[1:])]
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - common
    return common / total if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of tids whose texts overlap by SIMILARITY or more.

    texts has each tid once; both joins are shuffles on tid, whose large partitions AQE can split.
    """
    left = pairs.join(texts.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                x, y = _bags(part.column(2)), _bags(part.column(3))
                keep = pa.array([k for k in range(part.num_rows) if overlap(x[k], y[k]) >= SIMILARITY], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(tid, root): the least tid that each endpoint of the edges reaches. Labels move to the least neighbour's label,
    then jump to their label's label, until nothing changes; each round is written, so lineage stays short."""
    links = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    with tables() as old:
        label = staged(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("tid"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = links.join(label.select(F.col("tid").alias("b"), F.col("root").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        hooked = label.join(seen.withColumnRenamed("a", "tid"), "tid").select("tid", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = hooked.select(F.col("tid").alias("root"), F.col("root").alias("above"))
        with tables() as written:
            new = staged(hooked.join(up, "root", "left").select("tid", F.coalesce("above", "root").alias("root"), "old"), "labels")
        drop(edges.sparkSession, old)  # nothing reads the round before any more
        old = written
        moved = new.where(F.col("root") != F.col("old")).limit(1).count()
        label = new.select("tid", "root")
        if not moved:
            return label


def _shared_buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, n, tid, leader) of buckets with n > 1 texts. The order that leaders come first in differs between buckets.
    A part's leader has the bucket's as its own."""
    salted = sigs.select("tid", F.explode("buckets").alias("bucket"), F.pmod(F.xxhash64("tid"), F.lit(SALTS)).alias("salt"))
    band = salted.repartition("bucket", "salt")  # one exchange, which the counts and the rows both read
    turn = F.struct(F.xxhash64("tid", F.pmod("bucket", F.lit(3))).alias("turn"), "tid")
    parts = band.groupBy("bucket", "salt").agg(F.min(turn).alias("first"), F.count("*").alias("texts"))
    whole = Window.partitionBy("bucket")  # SALTS rows of one size at most, however many texts a bucket has
    known = parts.withColumn("n", F.sum("texts").over(whole)).withColumn("lead", F.min("first").over(whole)["tid"]).where("n > 1")
    facts = known.select("bucket", "salt", "n", F.col("first")["tid"].alias("own"), "lead")
    met = band.join(facts, ["bucket", "salt"])
    return met.select("bucket", "n", "tid", F.when(F.col("tid") == F.col("own"), F.col("lead")).otherwise(F.col("own")).alias("leader"))


def _texts_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tid, text, size in bytes), once each. Copies are reduced to one row a task before the texts are shuffled by tid; so
    the join, with each tid once on both sides, is no semi-join, which would be put before the reduction."""
    once = rows.groupBy("tid").agg(F.first("text").alias("text"))
    return once.join(nodes, "tid").select("tid", "text", F.octet_length("text").cast("long").alias("size"))


def _rest(buckets: DataFrame, label: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between texts of one bucket that the comparison with leaders left in different classes.

    The texts of such a bucket outside its largest class are dealt into blocks, and so are all its texts; each pair of
    blocks goes to a task, which computes all overlaps exactly from its own postings. A link is given only where it joins
    two classes of the task: fewer than it has texts.
    """
    member = buckets.select("bucket", "n", "tid").join(label, "tid", "left").withColumn("root", F.coalesce("root", "tid")).join(texts.select("tid", "size"), "tid")
    classes = member.groupBy("bucket", "n", "root").agg(F.count("*").alias("texts"), F.sum("size").alias("size"))
    largest = F.max(F.struct("texts", "size", "root"))
    several = classes.groupBy("bucket", "n").agg(F.count("*").alias("classes"), F.sum("size").alias("size"), largest.alias("largest")).where("classes > 1")
    blocks = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    facts = several.select(
        "bucket", F.col("largest.root").alias("most"), blocks(F.col("size")).alias("many"), blocks(F.col("size") - F.col("largest.size")).alias("few"),
        F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"),
    )
    turn = F.xxhash64("tid")
    open_ = staged(member.withColumn("salt", F.pmod(turn, salts).cast("int")).join(facts, ["bucket", "salt"]), "open")
    deal = lambda side, own, other: F.struct(F.lit(side).alias("side"), F.pmod(turn, own).cast("int").alias("own"), F.sequence(F.lit(0), other - 1).alias("other"))
    outside = F.when(F.col("root") != F.col("most"), deal(0, F.col("few"), F.col("many")))
    sides = open_.select("bucket", "tid", "root", F.explode(F.array(outside, deal(1, F.col("many"), F.col("few")))).alias("d")).where("d IS NOT NULL")
    dealt = sides.select("bucket", "tid", "root", "d.side", "d.own", F.explode("d.other").alias("other"))
    pick = lambda side: F.when(F.col("side") == side, F.col("own")).otherwise(F.col("other"))
    keyed = dealt.select("bucket", pick(0).alias("x"), pick(1).alias("y"), "side", "tid", "root").join(texts.select("tid", "text"), "tid")

    def run(part: pa.Table) -> pa.Table:
        side, root = part.column("side").to_numpy(), part.column("root").to_pylist()
        tid, bags = part.column("tid").to_pylist(), _bags(part.column("text"))
        out = [sorted((tid[i], tid[j])) for i, j in block_links(bags, side, root)]
        return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})

    return keyed.groupBy("bucket", "x", "y").applyInArrow(run, "a binary, b binary").distinct()


def block_links(bags: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, root: list) -> list[tuple[int, int]]:
    """Links that join the given classes, between bags of side 0 and bags of side 1, by exact overlap, one for each joining."""
    names = {r: k for k, r in enumerate(dict.fromkeys(root))}
    group = np.array([names[r] for r in root])
    size = np.array([n.sum() for _, n in bags])
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    count = np.concatenate([n for _, n in bags])
    shingle = np.unique(np.concatenate([h for h, _ in bags]), return_inverse=True)[1]
    own = np.searchsorted(doc, np.arange(len(bags) + 1))
    facing = np.flatnonzero(side[doc] == 1)
    order = facing[np.argsort(shingle[facing], kind="stable")]
    at = np.searchsorted(shingle[order], np.arange(shingle.max(initial=-1) + 2))
    links = []
    for i in np.flatnonzero(side == 0):
        mine = slice(own[i], own[i + 1])
        first, n = at[shingle[mine]], np.diff(at)[shingle[mine]]
        hits = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        common = np.bincount(doc[hits], np.minimum(count[hits], np.repeat(count[mine], n)), minlength=len(bags))
        near = (common >= SIMILARITY * (size + size[i] - common) - 1e-9) & (side == 1)
        for j in np.flatnonzero(near):
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                links.append((int(i), int(j)))
    return links


def _per_text(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(tid, least, n, root) of texts with a word. Rows of one text meet in partial aggregates first, so that a large
    group of copies is no hot key."""
    texts = rows.where(_worded()).groupBy("tid").agg(F.min("key").alias("least"), F.count("*").alias("n"))
    return staged(texts.join(label, "tid", "left").select("tid", "least", "n", F.coalesce("root", "tid").alias("root")), "texts")


def _worded():
    return F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def _labelled(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("tid", _tid("text"))
    sigs = staged(signed(rows.select("tid", "text")).dropDuplicates(["tid"]), "signatures")
    buckets = staged(_shared_buckets(sigs), "buckets")
    pairs = buckets.where(F.col("tid") != F.col("leader")).select(F.col("leader").alias("a"), F.col("tid").alias("b")).distinct()
    texts = staged(_texts_of(rows, buckets.select("tid").distinct()), "texts")  # each text with a partner once
    edges = staged(verified(pairs, texts), "edges")
    label = components(edges)
    more = staged(_rest(buckets, label, texts), "edges")
    if more.limit(1).count():
        label = components(edges.union(more))
    return rows, _per_text(rows, label)


def _tid(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, class_id (the least key of its class), n_class (its rows), tid (of its text)."""
    rows, per_text = _labelled(docs, key, text)
    group = per_text.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"))
    known = per_text.join(group, "root").select("tid", "class_id", "n_class")
    found = rows.where(_worded()).select("key", "tid").join(known, "tid").select(F.col("key").alias(key), "class_id", "n_class", "tid")
    alone = rows.where(~_worded()).select(F.col("key").alias(key), F.col("key").alias("class_id"), F.lit(1).cast("long").alias("n_class"), "tid")
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, with one row of each class: that of the least key (a null key only where the
    class has no other), and of rows that share it, any one of the first text's. Rows without words all stay."""
    _, per_text = _labelled(docs, key, text)
    best = per_text.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "tid")).alias("best"))
    mark = lambda k, tid: F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("null")).cast("binary"), tid))
    best = best.select(mark(F.col("best.least"), F.col("best.tid")).alias("lanewise_mark"))
    worded = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    marked = docs.where(worded).withColumn("lanewise_mark", mark(F.col(key), _tid(text)))
    same = Window.partitionBy("lanewise_mark").orderBy(F.lit(0))
    kept = marked.join(best, "lanewise_mark", "left_semi").withColumn("lanewise_rank", F.row_number().over(same)).where("lanewise_rank = 1")
    return kept.select(*docs.columns).unionByName(docs.where(~worded))
