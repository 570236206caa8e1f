"""The domain tables as projections of the given star schema, in DataFrame form and as SQL for the oracle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for today, so that results repeat.
AS_OF = "2001-08-02"
AS_OF_YEAR = 2001
GENDERS = ("women", "men", "mixed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Star:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def athlete(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            k.alias("athlete_id"),
            F.col("c_name").alias("athlete_name"),
            F.when(k % 2 == 0, "female").otherwise("male").alias("athlete_gender"),
            F.when(k % 41 != 0, (1940 + k % 70).cast("int")).alias("birth_year"),
            F.col("c_mktsegment").alias("segment"),
        )

    @cached_property
    def club(self) -> DataFrame:
        return (
            self.raw("supplier")
            .join(F.broadcast(self.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations, 5 regions
            .join(F.broadcast(self.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("club_name"), F.col("n_name").alias("city"), F.col("r_name").alias("region"))
        )

    @cached_property
    def event(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            k.alias("event_id"),
            F.col("p_name").alias("event_name"),
            F.concat(F.lower("p_type"), F.when(k % 11 == 0, "_relay").otherwise("")).alias("stroke"),
            (F.col("p_size") * 25).cast("int").alias("distance_m"),
            F.col("p_brand").alias("event_age_group"),
            F.when(k % 3 == 0, "women").when(k % 3 == 1, "men").otherwise("mixed").alias("event_gender"),
        )

    @cached_property
    def competition(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.raw("orders").select(
            k.alias("competition_id"),
            F.concat(F.lit("Meet "), k.cast("string")).alias("competition_name"),
            F.when(k % 53 != 0, F.col("o_orderdate").cast("date")).alias("start_date"),
            F.col("o_orderpriority").alias("scope"),
            F.col("o_orderstatus").alias("course"),
            F.col("o_custkey").alias("athlete_id"),
        )

    @cached_property
    def result(self) -> DataFrame:
        """The fact: one lineitem, its order's customer as the athlete."""
        f = F.col("l_returnflag")
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("competition_id"),
            F.col("l_partkey").alias("event_id"),
            F.when(F.col("l_suppkey") % 17 != 0, F.col("l_suppkey")).alias("club_id"),
            F.col("l_linenumber").cast("int").alias("rank_position"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("time_ms"),
            F.round(F.col("l_extendedprice") * 100 * (1 + F.col("l_tax"))).cast("long").alias("seed_ms"),
            F.when(f == "N", "valid").when(f == "A", "dns").when(F.col("l_linestatus") == "F", "dsq").alias("status"),
            F.when(f != "A", F.col("l_quantity").cast("decimal(10,2)")).alias("points"),
        )
        return lines.join(self.competition.select("competition_id", "athlete_id", "start_date", "scope", "course", "competition_name"), "competition_id")

    @cached_property
    def relay(self) -> DataFrame:
        """Relay members: one event row, its user as the athlete."""
        k = F.get_json_object("props", "$.k").cast("long")
        return self.raw("events").select(
            F.col("event_id").alias("observation_id"),
            F.col("user_id").alias("athlete_id"),
            F.when(k % 17 != 0, k).alias("club_id"),
            F.col("ts").cast("date").alias("start_date"),
            (F.col("event_id") % 4 + 1).cast("int").alias("leg_order"),
            F.col("event_type").alias("team"),
            F.round(F.col("value") * 100).cast("long").alias("time_ms"),
        )


#: The same tables for DuckDB.
STAR_SQL = """
WITH athlete AS (
  SELECT c_custkey AS athlete_id, c_name AS athlete_name, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS athlete_gender,
    CASE WHEN c_custkey % 41 <> 0 THEN (1940 + c_custkey % 70)::INTEGER END AS birth_year, c_mktsegment AS segment FROM customer
), club AS (
  SELECT s_suppkey AS club_id, s_name AS club_name, n_name AS city, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), event AS (
  SELECT p_partkey AS event_id, p_name AS event_name, lower(p_type) || CASE WHEN p_partkey % 11 = 0 THEN '_relay' ELSE '' END AS stroke,
    (p_size * 25)::INTEGER AS distance_m, p_brand AS event_age_group,
    CASE p_partkey % 3 WHEN 0 THEN 'women' WHEN 1 THEN 'men' ELSE 'mixed' END AS event_gender FROM part
), competition AS (
  SELECT o_orderkey AS competition_id, 'Meet ' || o_orderkey AS competition_name, CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate::DATE END AS start_date,
    o_orderpriority AS scope, o_orderstatus AS course, o_custkey AS athlete_id FROM orders
), result AS (
  SELECT l_orderkey AS competition_id, l_partkey AS event_id, CASE WHEN l_suppkey % 17 <> 0 THEN l_suppkey END AS club_id, l_linenumber::INTEGER AS rank_position,
    round(l_extendedprice * 100)::BIGINT AS time_ms, round(l_extendedprice * 100 * (1 + l_tax))::BIGINT AS seed_ms,
    CASE WHEN l_returnflag = 'N' THEN 'valid' WHEN l_returnflag = 'A' THEN 'dns' WHEN l_linestatus = 'F' THEN 'dsq' END AS status,
    CASE WHEN l_returnflag <> 'A' THEN l_quantity::DECIMAL(10,2) END AS points, athlete_id, start_date, scope, course, competition_name
  FROM lineitem JOIN competition ON l_orderkey = competition_id
), relay AS (
  SELECT event_id AS observation_id, user_id AS athlete_id, CASE WHEN json_extract(props, '$.k')::BIGINT % 17 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS club_id,
    ts::DATE AS start_date, (event_id % 4 + 1)::INTEGER AS leg_order, event_type AS team, round(value * 100)::BIGINT AS time_ms FROM events
)
"""
