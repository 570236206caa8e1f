"""A Merkle manifest of a dataset with a proof for every row, by pointer jumping, in DataFrame functions only.

A row's leaf is the SHA-256 of its fields, each with its length, so no two rows of different fields share a leaf. The
leaves of a group ascend by key; every FAN consecutive nodes become the digest of their digests until one is left, the
group's subroot, and the subroots, by group, become the root in the same way.

Places come from a range sort: rows are written with their running number in their task, and the sizes of the tasks before
are added; no group is gathered anywhere. Every inner node then holds a segment, its siblings, and a pointer to its parent.
Each round joins the nodes with themselves: a node takes over the pointer of the node that it points to and appends that
node's segment, so the distance doubles and ceil(log2(height)) rounds bring every node to the root. The leaves of a run lie
in one row next to their common parent and take its segment at the end, so segments are stored once in FAN leaves.

Null fields count as '-' and differ from empty ones. Null keys come first in their group, the null group before all others.
Repeated rows are leaves of their own, equal ones in any order; keys that repeat are ordered by their leaves. Very long
texts are digested whole, in the first pass, and not moved. An empty table has no leaves, no root and no rows. Columns that
aren't named are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.llm.common import staged
from lanewise.operators.core import small_side

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree over the subroots count from here, so they come after the levels of any group.
TOP = 100
#: Nodes that others point to are broadcast up to so many bytes (their number times the greatest segment).
BROADCAST_BYTES = 8 << 20


def digest(*fields: Column) -> Column:
    """The leaf of a row: SHA-256, as lowercase hex, of the fields' UTF-8 lengths and values."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _numbered(rows: DataFrame, keys: list[str], order: list[str], tag: str) -> tuple[DataFrame, DataFrame]:
    """rows, written in order with their task and running number, and (keys, task, first, before, total): where each key's rows
    of a task begin, and how many of the key come before and at all."""
    ordered = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    dealt = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    written = staged(dealt.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("number")), tag)
    sizes = written.groupBy(*keys, "task").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    of_key = Window.partitionBy(*keys)
    before = of_key.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return written, sizes.select(*keys, "task", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_key).alias("total"))


def _place() -> Column:
    """A numbered row's place in its key."""
    return F.col("before") + F.col("number") - F.col("first")


def _siblings(members: Column, at: Column, value: str = "digest") -> Column:
    """The digests before and after place `at` (from 0) of a run, each side joined."""
    digests = F.transform(members, lambda m: m[value])
    side = lambda a, n: F.array_join(F.slice(digests, a, n), "")
    return F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(FAN)).alias("right"))


def _climbed(nodes: DataFrame, level: int, root_total: int | None, tag: str) -> tuple[DataFrame, DataFrame]:
    """From nodes (gid, idx, total, digest) of a level, total being the leaves below the whole group: the nodes of the next level
    and the links of these to them. root_total: groups of at most so many leaves end in the root there."""
    runs = staged(
        nodes.groupBy("gid", F.expr(f"idx div {FAN}").alias("run")).agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("members")), tag
    )
    above = runs.select("gid", F.col("run").alias("idx"), "total", _sha(F.array_join(F.transform("members", lambda m: m["digest"]), "")).alias("digest"))
    each = runs.select("gid", "run", "total", "members", F.posexplode("members").alias("at", "member"))
    ends = F.lit(False) if root_total is None else F.col("total") <= root_total
    up = F.when(~ends, F.struct(F.lit(level + 1).alias("level"), F.col("gid"), F.col("run").alias("idx")))
    links = each.select(F.lit(level).alias("level"), "gid", F.col("member.idx").alias("idx"), up.alias("up"), F.array(_siblings(F.col("members"), F.col("at"))).alias("segment"))
    return above, links


def jumped(links: DataFrame, height: int) -> DataFrame:
    """links (level, gid, idx, up, segment) with every pointer at the root, which is null: the segments of all levels up to it."""
    distance = 1
    while distance < height:
        done, pending = links.where("up IS NULL"), links.where("up IS NOT NULL")
        # a node that is pointed to is at least `distance` levels above the lowest ones
        targets = links.where(F.col("level") > distance).select(*[F.col(c).alias(f"t_{c}") for c in ("level", "gid", "idx", "up", "segment")])
        row_bytes = distance * 2 * 64 * FAN
        if targets.limit(BROADCAST_BYTES // row_bytes + 1).count() <= BROADCAST_BYTES // row_bytes:
            targets = F.broadcast(targets)
        same = (F.col("up.level") == F.col("t_level")) & (F.col("up.gid") == F.col("t_gid")) & (F.col("up.idx") == F.col("t_idx"))
        further = pending.join(targets, same).select("level", "gid", "idx", F.col("t_up").alias("up"), F.concat("segment", "t_segment").alias("segment"))
        links = staged(done.unionByName(further), "pointers")
        distance *= 2
    return links


def folded(leaf: Column, segment: Column) -> Column:
    """The digest that a leaf and a segment give."""
    return F.aggregate(segment, leaf, lambda below, s: _sha(F.concat(s["left"], below, s["right"])))


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "source", leaf: str = "leaf", carry: Sequence[str] = ()) -> DataFrame:
    """One row a leaf: key, group, leaf, the carried columns, subroot, root and segment, which holds for each level up to the root
    the digests on the left and on the right, joined."""
    spark = leaves.sparkSession
    named = leaves.select(F.col(key).alias("key"), F.col(group).alias("group"), F.col(leaf).alias("leaf"), F.struct(F.lit(0), *carry).alias("carried"))
    slim = staged(named.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    rows, bases = _numbered(slim, ["group"], ["key", "leaf", "tie"], "ordered")
    sizes = staged(bases, "sizes")
    groups, order = _numbered(sizes.groupBy("group").agg(F.max("total").alias("leaves")), [], ["group"], "groups")
    names = groups.join(small_side(order), "task").select(F.col("group").alias("name"), _place().alias("gid"))
    sizes = sizes.join(small_side(names), F.col("group").eqNullSafe(F.col("name"))).select(F.col("group").alias("g"), F.col("task").alias("t"), "first", "before", "total", "gid")
    least = groups.agg(F.max("leaves"), F.count("*")).first()
    largest, n_groups = least[0] or 0, least[1]
    placed = rows.join(small_side(sizes), (F.col("task") == F.col("t")) & F.col("group").eqNullSafe(F.col("g")))
    members = placed.select("gid", "group", "total", _place().alias("place"), "key", "leaf", "carried").groupBy("gid", F.expr(f"place div {FAN}").alias("run"))
    runs = staged(members.agg(F.max("total").alias("total"), F.first("group").alias("group"), F.array_sort(F.collect_list(F.struct("place", "key", "leaf", "carried"))).alias("members")), "runs")
    joined = F.array_join(F.transform("members", lambda m: m["leaf"]), "")
    nodes = runs.select("gid", F.col("run").alias("idx"), "total", F.when(F.col("total") == 1, F.col("members")[0]["leaf"]).otherwise(_sha(joined)).alias("digest"))
    links, level, height = [], 1, max(_height(largest), 1)
    subroots = nodes.where(F.col("total") <= FAN).select("gid", F.lit(1).alias("level"), "digest")
    while level < height:
        nodes, up = _climbed(nodes.where(F.col("total") > FAN**level), level, FAN ** (level + 1) if n_groups == 1 else None, "level")
        level += 1
        ended = nodes.where(F.col("total") <= FAN**level)
        links, subroots = [*links, up], subroots.unionByName(ended.select("gid", F.lit(level).alias("level"), "digest"))
    subroots = staged(subroots, "subroots")
    tops, at = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("idx"), F.lit(n_groups).cast("long").alias("total"), "digest"), 0
    while at < _height(n_groups):
        tops, up = _climbed(tops, TOP + at, FAN ** (at + 1), "top")
        if at == 0:  # the lowest nodes of this tree are the groups' own tops
            own = subroots.select(F.col("gid").alias("s_gid"), F.col("level").alias("s_level"))
            up = up.join(small_side(own), F.col("idx") == F.col("s_gid")).select(F.col("s_level").alias("level"), F.col("s_gid").alias("gid"), F.lit(0).cast("long").alias("idx"), "up", "segment")
        links, at = [*links, up], at + 1
    root = tops.select(F.col("digest").alias("root"))
    if not links:
        links = [spark.createDataFrame([], "level int, gid bigint, idx bigint, up struct<level:int,gid:bigint,idx:bigint>, segment array<struct<left:string,right:string>>")]
    paths = links[0]
    for more in links[1:]:
        paths = paths.unionByName(more)
    depth = _height(n_groups) + height - 1
    paths = jumped(staged(paths, "links"), depth).where("level = 1").select(F.col("gid").alias("p_gid"), F.col("idx").alias("p_idx"), F.col("segment").alias("above"))
    own = subroots.select(F.col("gid").alias("s_gid"), F.col("digest").alias("subroot"))
    known = runs.join(small_side(own), F.col("gid") == F.col("s_gid")).join(paths, (F.col("gid") == F.col("p_gid")) & (F.col("run") == F.col("p_idx")), "left")
    each = known.join(F.broadcast(root)).select("*", F.posexplode("members").alias("at", "member"))  # one row
    lowest = F.when(F.col("total") > 1, F.array(_siblings(F.col("members"), F.col("at"), "leaf"))).otherwise(F.array())
    segment = F.concat(lowest, F.coalesce(F.col("above"), F.array()))
    carried = [F.col("member.carried")[c].alias(c) for c in carry]
    return each.select(F.col("member.key").alias(key), F.col("group").alias(group), F.col("member.leaf").alias(leaf), *carried, "subroot", "root", segment.alias("segment"))


def proof_digest(segment: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return _sha(F.array_join(F.transform(segment, lambda s: F.concat(s["left"], s["right"])), ""))


def verified(docs: DataFrame, claimed: dict[str, Column], where: Column, key: str = "doc_id", group: str = "source", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The manifest of docs, and whether rows that are claimed to be other than they are (the given fields replaced, where `where`
    holds) still give the root: key, group, leaf, claim, subroot, root, segment, folded_root, verified."""
    own = digest(*[F.col(f) for f in fields])
    other = digest(*[claimed.get(f, F.col(f)) for f in fields])
    leaves = docs.select(F.col(key), F.col(group), own.alias("leaf"), F.when(where, other).otherwise(own).alias("claim"))
    proofs = manifest(leaves, key, group, "leaf", ["claim"]).withColumn("folded_root", folded(F.col("claim"), F.col("segment")))
    return proofs.withColumn("verified", F.col("folded_root") == F.col("root"))
