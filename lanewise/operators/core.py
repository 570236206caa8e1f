"""Operators that the plans share. None of them gathers a table anywhere; each says how it is dealt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A side may be broadcast up to so many rows; small_side() checks it.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it proves to have at most BROADCAST_ROWS rows, else df as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to as many tasks as a shuffle has: files of columns hold many rows in few bytes, so few tasks read them, too few
    where each row takes long."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows that a task of dealt() is meant to hold.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of some `rows` rows, dealt out by the keys to tasks that grow in number with the rows, so that no task's memory does; to no
    fewer than a shuffle has, which adaptive merging by bytes would make one where bytes are few and rows take long."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), *keys)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the given total order. The rank limit runs before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column, into: str = "place") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(into, rank).where(F.col(into) <= n)


def global_rank(df: DataFrame, bucket: Column, *order: Column, into: str = "rank") -> DataFrame:
    """The row number over all rows, without sorting them in one task: rows are ranked within buckets, which the order must
    agree with (a lower bucket ranks before a higher one), and the sizes of the buckets before are added. Only the sizes,
    one row a bucket, meet in one place. Sizes and ranks both read df: settle it before where it is dear."""
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    ranked = rows.withColumn("_within", within).join(sizes, F.col("_bucket").eqNullSafe(F.col("_b")))
    return ranked.withColumn(into, F.col("_before") + F.col("_within")).drop("_bucket", "_b", "_before", "_within")


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the predicates that are given."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def wanted(column: Column, value) -> Column | None:
    """column == value, or no predicate for None and 'all'."""
    return None if value is None or value == "all" else column == value


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` from 1; needs a total order. A top-k report: offset and limit are its feature."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("pages count from 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def missing_from(batch: DataFrame, core: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose keys core lacks, nulls being equal. Duplicates in the batch must be gone before."""
    left, right = batch.alias("l"), core.select(*keys).distinct().alias("r")
    return left.join(right, all_of(*[F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]), "left_anti")


def best_match(rows: DataFrame, candidates: DataFrame, on: Column, row_key: list[str], *order: Column) -> DataFrame:
    """Every row with its best candidate or nulls: an equi-join and a rank in place of a correlated LIMIT 1."""
    return first_by(rows.join(candidates, on, "left"), row_key, *order)


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each row with the value of the last mark of its group at or before it; marks come first on a tie.

    One shuffle by group and one sort: marks and rows are united and the last value is carried forward.
    """
    tagged = marks.select(*by, *order, F.col(value).alias("_mark"), F.lit(0).alias("_kind")).unionByName(
        rows.withColumn("_kind", F.lit(1)).withColumn("_mark", F.lit(None).cast(marks.schema[value].dataType)), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(*order, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn(value, F.last("_mark", ignorenulls=True).over(w)).where("_kind = 1").select(*rows.columns, value)


def band_pairs(df: DataFrame, block: list[str], number: str, reach: int, key: str) -> DataFrame:
    """Pairs (a, b), key a < key b, of one block whose numbers differ by at most reach: a row meets those of its own number and, laid
    out in their bands, of the numbers above it."""
    own = [F.col(key).alias("_key"), F.col(number).alias("_number")]
    low = df.select(*block, F.col(number).alias("_band"), *own)
    high = df.select(*block, F.explode(F.array(*[F.col(number) - d for d in range(reach + 1)])).alias("_band"), *own)
    met = dealt_pairs(low, high, [*block, "_band"]).where("l._key <> r._key AND (l._number < r._number OR l._key < r._key)")
    first = F.col("l._key") < F.col("r._key")
    a, b = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in ("lr", "rl"))
    sided = met.select(*block, a.alias("_a"), b.alias("_b"))
    return sided.select(*block, F.col("_a._key").alias("a"), F.col("_a._number").alias("number_a"), F.col("_b._key").alias("b"), F.col("_b._number").alias("number_b"))


#: Rows of a chunk, and pairs of rows that a task of dealt_pairs works out.
CHUNK, PAIRS_A_TASK, MOST_TASKS = 500, 4_000_000, 2000


def dealt_pairs(left: DataFrame, right: DataFrame, keys: list[str], unordered: str | None = None) -> DataFrame:
    """(*keys, l, r): each row of left with each row of right of equal keys, as structs of their other columns. Rows are packed
    into chunks of some CHUNK, chunks meet on the keys and are dealt out before they are unpacked, so that a key of many rows
    is worked on by many tasks and the shuffle grows with the chunks, not with the pairs. unordered names a column of left
    that is unique, right being left: then each pair of different rows comes once, in one of its two orders."""

    def packed(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        df = df.where(all_of(*[F.col(k).isNotNull() for k in keys]))
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
        rest = F.struct(*[c for c in df.columns if c not in keys])
        chunk = F.pmod(F.xxhash64(rest), F.ceil(F.col("_rows") / CHUNK))
        rows = df.join(sizes, keys).select(*keys, chunk.alias(f"_{name}_chunk"), rest.alias(name))
        return rows.groupBy(*keys, f"_{name}_chunk").agg(F.collect_list(name).alias(f"_{name}s")), sizes

    (ls, left_sizes), (rs, right_sizes) = packed(left, "l"), packed(right, "r")
    pairs = left_sizes.join(right_sizes.withColumnRenamed("_rows", "_others"), keys).agg(F.sum(F.col("_rows").cast("double") * F.col("_others"))).first()[0] or 0
    tasks = min(max(1, int(pairs) // PAIRS_A_TASK), MOST_TASKS)
    met = ls.join(rs, keys)
    if unordered:
        met = met.where("_l_chunk <= _r_chunk")
    met = met.repartition(tasks, *keys, "_l_chunk", "_r_chunk")
    each = met.withColumn("l", F.explode("_ls")).withColumn("r", F.explode("_rs"))
    if unordered:
        each = each.where((F.col("_l_chunk") < F.col("_r_chunk")) | (F.col(f"l.{unordered}") < F.col(f"r.{unordered}")))
    return each.select(*keys, "l", "r")


def occurrence_names(df: DataFrame, key: list[str], name: str, *order: Column) -> DataFrame:
    """`name` made unique within its key: the second gets -2, the third -3."""
    n = F.row_number().over(Window.partitionBy(*key, name).orderBy(*order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name)))


def closure(pairs: DataFrame, source: str, target: str, most_rounds: int = 40) -> DataFrame:
    """Each source with the end of its chain: pointer doubling, one join a round, so chains of length n take log n rounds.

    A chain that runs into a cycle ends at the least name that it passes. Rounds end when no further source has reached its
    end and no least name has changed: what is left then lies on cycles. Beyond most_rounds (chains of 2**most_rounds) it
    raises. Rounds are checkpointed where the session has a checkpoint folder, else cached and released.
    """
    jump = pairs.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s IS NOT NULL AND t IS NOT NULL AND s <> t").groupBy("s").agg(F.min("t").alias("t"))
    jump = jump.withColumn("low", F.least("s", "t")).withColumn("open", F.lit(True))
    persistent, before, held = df_has_checkpoint(pairs), None, None
    for _ in range(most_rounds):
        far = jump.select(F.col("s").alias("t"), F.col("t").alias("t2"), F.col("low").alias("low2"))
        least = F.least("low", F.coalesce("low2", "low"))
        new = jump.join(far, "t", "left").select("s", F.coalesce("t2", "t").alias("t"), least.alias("low"), F.col("t2").isNotNull().alias("open"), (least != F.col("low")).alias("moved"))
        new = new.checkpoint() if persistent else new.cache()
        state = new.agg(F.count_if("open").alias("open"), F.count_if("moved").alias("moved")).first()
        if held is not None and not persistent:
            held.unpersist()
        held, jump = new, new.select("s", "t", "low", "open")
        if not state["open"] or (before == state["open"] and not state["moved"]):
            break
        before = state["open"]
    else:
        raise ValueError(f"chains longer than 2**{most_rounds}")
    return jump.select(F.col("s").alias(source), F.when(F.col("open"), F.col("low")).otherwise(F.col("t")).alias(target))


def df_has_checkpoint(df: DataFrame) -> bool:
    return bool(df.sparkSession.sparkContext.getCheckpointDir())


def settled(df: DataFrame) -> DataFrame:
    """df worked out once for the several branches that read it: a checkpoint where the session has a folder for it, else cached."""
    return df.checkpoint() if df_has_checkpoint(df) else df.cache()


def carry_forward(df: DataFrame, by: list[str], order: list[str], column: Column, into: str) -> DataFrame:
    """The last value that isn't null up to each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(column, ignorenulls=True).over(w))


def interval_join(points: DataFrame, bands: DataFrame, keys: list[str], at: str, left: str, right: str, cell: float) -> DataFrame:
    """points with every band of their keys that holds them, left <= at < right: bands are laid out in cells of the axis, points
    meet them by an equi-join on their cell, then the exact bounds decide. Bands should span few cells each."""
    n = lambda c: F.floor(F.col(c) / cell)
    laid = bands.where(F.col(left) < F.col(right)).withColumn("_cell", F.explode(F.sequence(n(left), n(right))))
    met = points.withColumn("_cell", n(at)).join(laid, [*keys, "_cell"])
    return met.where((F.col(at) >= F.col(left)) & (F.col(at) < F.col(right))).drop("_cell")
