"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Vectors get one coordinate more, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries), so that the largest inner
product is the least angle; signs of random projections then give each of `TREES` trees a hash string of `BITS` bits. A
tree is the array of its strings in order. A query descends to the part of each tree's array that shares its longest
prefix and ascends bit by bit, tree after tree, all trees in step, until the parts hold `BUDGET` times as many
candidates as there are vectors, and k + 1 a tree at least, so that a list of k is full if the table can fill it; every
candidate's product is computed exactly.

The counts of the prefixes, at most TREES * 2**TOP of them, are all that the driver sees; they tell each query how far
to ascend. The arrays are dealt by tree and prefix cell, cells of over `BLOCK` vectors in several blocks, and queries go
to the cells that their prefixes cover. Equal vectors are indexed once, with their k + 1 least ids, which is all a list
of k can show; so a large group of copies is no large part of an array.

Take no part: null vectors, zero vectors, vectors with null or non-finite components, rows without an id. Vectors of
different lengths have no product, so each length is a table of its own. Rows of one id with equal vectors are one row;
different vectors of one id are candidates each, and queries each with a list of their own. Ties go to the smaller id. An
empty table gives no rows. Columns but the named ones are left alone.

BUDGET is a share because recall must hold for vectors without clusters: for directions at random, hash prefixes of near
and far vectors differ so little that 0.9 of the true neighbours only come with about as many products as a scan makes.
Where the data cluster, a smaller share does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import staged

TREES, BITS, TOP = 16, 30, 10
BUDGET = 1.8
BLOCK = 4096
K = 20


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vkey: a digest of the vector, vec: its doubles' bytes, dim), one row an id and vector."""
    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    slim = slim.where(F.col("id").isNotNull() & F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            lists = batch.column(1)
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # null: NaN; -0.0: 0.0
            for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                v = flat[a:b]
                if b > a and np.isfinite(v).all() and v.any():
                    out.append((ids[k], v.tobytes(), int(b - a)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int32())], names=["id", "vec", "dim"]
            )

    rows = slim.mapInArrow(run, "id bigint, vec binary, dim int").withColumn("vkey", F.unhex(F.md5("vec")))
    return staged(rows.groupBy("id", "vkey").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim")), "vectors")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vkey, vec, ids: the k + 1 least) of each different vector. The rank limit cuts copies before the shuffle."""
    w = Window.partitionBy("vkey").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    return few.groupBy("vkey").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((dim + 1, TREES * BITS))


def codes(x: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Hash strings (rows x TREES, int64) of vectors with the extra coordinate `tail`."""
    bits = (np.column_stack([x, tail]) @ _planes(x.shape[1]) > 0).reshape(len(x), TREES, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def ascend(query: np.ndarray, counts: np.ndarray, wanted: float) -> np.ndarray:
    """Prefix lengths (queries x TREES) at which a query's parts hold `wanted` candidates or, at length 0, everything.

    counts: TREES x 2**TOP, vectors of each prefix of TOP bits. All trees stand at one length; those before the last one
    that had to ascend stand one bit higher.
    """
    depth = np.full(query.shape, TOP)
    done = np.zeros(len(query), bool)
    held = np.stack([counts[t][query[:, t] >> (BITS - TOP)] for t in range(TREES)], axis=1)
    done |= held.sum(axis=1) >= wanted
    level = counts
    for length in range(TOP - 1, -1, -1):
        level = level.reshape(TREES, -1, 2).sum(axis=2)
        for t in range(TREES):
            more = ~done
            if not more.any():
                return depth
            held[more, t] = level[t][query[more, t] >> (BITS - length)]
            depth[more, t] = length
            done |= held.sum(axis=1) >= wanted
    return depth


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def neighbours(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = K, budget: float = BUDGET) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by `every`. One search for each length of vectors."""
    rows = usable(vectors, key, vector)
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim in sorted(r["dim"] for r in rows.select("dim").distinct().collect()):
        out = out.unionByName(_search_all(rows.where(F.col("dim") == dim), dim, every, k, budget))
    return out


def _search_all(rows: DataFrame, dim: int, every: int, k: int, budget: float) -> DataFrame:
    points = staged(distinct_vectors(rows, k), "points")
    longest = float(points.select("vec").mapInArrow(_norms(dim), "norm double").agg(F.max("norm")).collect()[0][0])
    hashed = staged(points.mapInArrow(_hashed(dim, longest), "vkey binary, vec binary, ids array<bigint>, codes array<bigint>"), "hashed")
    tops = hashed.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", F.expr(f"shiftright(code, {BITS - TOP})").alias("top")).count().collect()
    counts = np.zeros((TREES, 1 << TOP), np.int64)
    for tree, top, n in tops:
        counts[tree, top] = n
    total = int(counts[0].sum())
    bits = int(min(TOP, max(3, np.ceil(np.log2(max(1, total / BLOCK))))))
    cells = counts.reshape(TREES, 1 << bits, -1).sum(axis=2)
    blocks = np.maximum(1, -(-cells // BLOCK))
    dealt = hashed.mapInArrow(_dealt_points(bits, blocks), "tree int, cell int, block int, code bigint, vkey binary, vec binary, least bigint")
    asked = rows.where(F.col("id") % every == 0).select("id", "vkey")
    wanted_vectors = asked.select("vkey").distinct().join(points.select("vkey", "vec"), "vkey")
    queries = wanted_vectors.mapInArrow(_dealt_queries(dim, bits, blocks, counts, max(budget * total, TREES * (k + 1))), "tree int, cell int, block int, code bigint, depth int, vkey binary, vec binary")
    found = (
        dealt.groupBy("tree", "cell", "block")
        .cogroup(queries.groupBy("tree", "cell", "block"))
        .applyInArrow(_search(dim, k + 1), "query binary, found array<struct<score: double, least: bigint, vkey: binary>>")
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    pairs = found.select("query", F.explode("found").alias("f")).select("query", "f.score", "f.least", "f.vkey").dropDuplicates(["query", "vkey"])
    top = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    listed = top.join(points.select("vkey", "ids"), "vkey").select("query", "score", F.col("vkey").alias("near"), F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1)
    own = asked.withColumnRenamed("id", "query_id").join(listed.withColumnRenamed("query", "vkey"), "vkey")
    own = own.where((F.col("vec_id") != F.col("query_id")) | (F.col("near") != F.col("vkey")))
    last = Window.partitionBy("query_id", "vkey").orderBy(F.desc("score"), "vec_id")
    return own.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norms(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(_matrix(batch.column(0), dim), axis=1))], names=["norm"])

    return run


def _hashed(dim: int, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            tail = np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))
            c = codes(x, tail)
            lists = pa.ListArray.from_arrays(np.arange(0, c.size + 1, TREES, dtype=np.int32), c.reshape(-1))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vkey", "vec", "ids", "codes"])

    return run


def _dealt_points(bits: int, blocks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                batch = big.slice(lo, 1024)
                n = batch.num_rows
                code = np.array(batch.column(3).to_pylist(), np.int64).reshape(n, TREES)
                mark = np.array([int.from_bytes(x[:6], "little") for x in batch.column(0).to_pylist()], np.int64)
                row, tree = np.repeat(np.arange(n), TREES), np.tile(np.arange(TREES), n)
                cell = code[row, tree] >> (BITS - bits)
                take = pa.array(row)
                least = np.array([x[0] for x in batch.column(2).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array((mark[row] % blocks[tree, cell]).astype(np.int32)), pa.array(code[row, tree]),
                     batch.column(0).take(take), batch.column(1).take(take), pa.array(least[row])],
                    names=["tree", "cell", "block", "code", "vkey", "vec", "least"],
                )

    return run


def _dealt_queries(dim: int, bits: int, blocks: np.ndarray, counts: np.ndarray, wanted: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                batch = big.slice(lo, 256)
                x = _matrix(batch.column(1), dim)
                code = codes(x, np.zeros(len(x)))
                depth = ascend(code, counts, wanted)
                out = []
                for q in range(len(x)):
                    for t in range(TREES):
                        d, c = int(depth[q, t]), int(code[q, t])
                        first = c >> (BITS - bits) if d >= bits else (c >> (BITS - d)) << (bits - d)
                        for cell in range(first, first + (1 << max(0, bits - d))):
                            out += [(t, cell, b, c, d, q) for b in range(int(blocks[t, cell]))]
                table = np.array(out, np.int64).reshape(-1, 6)
                take = pa.array(table[:, 5])
                ints = [pa.array(table[:, i].astype(np.int32)) for i in (0, 1, 2, 4)]
                yield pa.RecordBatch.from_arrays(
                    [*ints[:3], pa.array(table[:, 3]), ints[3], batch.column(0).take(take), batch.column(1).take(take)],
                    names=["tree", "cell", "block", "code", "depth", "vkey", "vec"],
                )

    return run


def _search(dim: int, k: int):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("least", pa.int64()), ("vkey", pa.binary())]))

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        names, answers = [], []
        if points.num_rows and queries.num_rows:
            points = points.take(pa.array(np.argsort(points.column("code").to_numpy(), kind="stable")))
            code = points.column("code").to_numpy()
            x, least, vkey = _matrix(points.column("vec"), dim), points.column("least").to_numpy(), points.column("vkey").to_pylist()
            q, depth = _matrix(queries.column("vec"), dim), queries.column("depth").to_numpy()
            low = (queries.column("code").to_numpy() >> (BITS - depth)) << (BITS - depth)
            name = queries.column("vkey").to_pylist()
            slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()  # of a matrix product's rounding
            for part in _parts(low, depth):
                a, b = np.searchsorted(code, [low[part[0]], low[part[0]] + (1 << int(BITS - depth[part[0]]))])
                for at in np.array_split(part, -(-len(part) // 256)) if b > a else ():
                    product = q[at] @ x[a:b].T
                    kept = min(k, b - a)
                    bar = np.partition(product, b - a - kept, axis=1)[:, b - a - kept]
                    for row, i in enumerate(at):
                        near = a + np.flatnonzero(product[row] >= bar[row] - slack[i])
                        score = (x[near] * q[i]).sum(axis=1)
                        order = np.lexsort((least[near], -score))[:kept]
                        names.append(name[i])
                        answers.append([{"score": float(score[o]), "least": int(least[near[o]]), "vkey": vkey[near[o]]} for o in order])
        return pa.table({"query": pa.array(names, pa.binary()), "found": pa.array(answers, kind)})

    return run


def _parts(low: np.ndarray, depth: np.ndarray) -> Iterator[np.ndarray]:
    """Queries of one prefix together."""
    order = np.lexsort((low, depth))
    cuts = np.flatnonzero((np.diff(low[order]) != 0) | (np.diff(depth[order]) != 0)) + 1
    yield from np.split(order, cuts)
