"""Parser bundles (folders of CSV files), manifests (JSON lines) and their sinks. Everything is read as text and cast later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Files of a bundle with their columns.
REQUIRED = {
    "club": "name short_name city region source_id",
    "event": "competition_id event_name stroke distance_m gender age_group round_type source_id",
    "athlete": "full_name gender club_name birth_year source_id",
    "result": "event_name athlete_name club_name rank_position seed_time_text seed_time_ms result_time_text result_time_ms age_at_event birth_year_estimated points status source_id",
}
OPTIONAL = {
    "relay_team": "event_name club_name relay_team_name rank_position seed_time_text seed_time_ms result_time_text result_time_ms points status source_id page_number line_number",
    "relay_swimmer": "event_name relay_team_name leg_order swimmer_name gender age_at_event birth_year_estimated page_number line_number",
}
#: Columns that a file may lack.
MAY_LACK = {"athlete": {"birth_year"}, "relay_team": {"club_name"}}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Trimmed headers without byte-order mark, the contract's columns in its order; a missing one fails, others are dropped."""
    wanted = (REQUIRED | OPTIONAL)[name].split()
    found = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    missing = [c for c in wanted if c not in found.columns]
    if hard := set(missing) - MAY_LACK.get(name, set()):
        raise ValueError(f"{name}: missing columns {sorted(hard)}")
    return found.select(*[F.col(c).cast("string") if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Asked of the path's own file system, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a bundle; the two relay files come together or not at all."""
    absent = [n for n in REQUIRED if not exists(spark, f"{folder}/{n}.csv")]
    if absent:
        raise FileNotFoundError(f"{folder}: missing {absent}")
    optional = [n for n in OPTIONAL if exists(spark, f"{folder}/{n}.csv")]
    if len(optional) == 1:
        raise FileNotFoundError(f"{folder}: {optional[0]} without its pair")
    return {n: conform(read_csv(spark, f"{folder}/{n}.csv"), n) for n in [*REQUIRED, *optional]}


def read_csv_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_csv(spark, path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file with comma or semicolon, decided by its first line, in UTF-8, or in windows-1252 where it isn't UTF-8. Spark's reader has
    no windows-1252: it is read as Latin-1, whose 32 control characters then become the quotes and dashes that they stand for."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    odd = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    df = read_csv(spark, path, ";" if line.count(";") > line.count(",") else ",", "iso-8859-1" if odd else "UTF-8")
    if odd:
        control = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
        shown = [(a, z) for a, z in control if z]
        marks = ["".join(x) for x in zip(*shown)]
        df = df.select(*[F.translate(F.col(f"`{c}`"), *marks).alias(c.translate(str.maketrans(*marks))) for c in df.columns])
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def read_manifest(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines, # comments and a byte-order mark are skipped; lines that are no object fail, or are
    dropped where not strict."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    bad = lines.where(~F.col("line").startswith("{") | F.try_parse_json("line").isNull())
    if strict:
        first = bad.limit(1).collect()
        if first:
            raise ValueError(f"{path}: not an object: {first[0][0][:80]}")
        return lines.select(F.from_json("line", schema).alias("x")).select("x.*")
    return lines.where(F.col("line").startswith("{") & F.try_parse_json("line").isNotNull()).select(F.from_json("line", schema).alias("x")).select("x.*")


def freeze(manifest: DataFrame, states: DataFrame, allowed: list[str], order: str = "position") -> DataFrame:
    """Entries whose state is allowed, the first of each URL."""
    from lanewise.operators.core import first_by

    kept = manifest.join(states.where(F.col("state").isin(*allowed)).select("input_dir"), "input_dir", "left_semi")
    return first_by(kept.withColumn("_url", F.coalesce("source_url", "input_dir")), ["_url"], F.asc(order)).drop("_url")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV files that begin with a byte-order mark: it stands before the first header, which each file has once."""
    first, *rest = df.columns
    marked = df.select(F.col(first).alias("\ufeff" + first), *rest)
    marked.write.mode("overwrite").option("header", True).option("sep", sep).option("quoteAll", False).csv(path)


def write_bundle(frames: dict[str, DataFrame], folder: str, metadata: dict[str, str]) -> None:
    """A folder a frame, and the metadata as one JSON line."""
    for name, df in frames.items():
        write_csv(df, f"{folder}/{name}.csv")
    spark = next(iter(frames.values())).sparkSession
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in metadata.items()])
    write_jsonl(row.coalesce(1), f"{folder}/metadata.json")


def write_summary(counts: DataFrame, path: str) -> None:
    """A one-row summary as JSON, secrets out of its addresses."""
    safe = [F.regexp_replace(c, r"://[^/@\s]+@", "://***@").alias(c) if t == "string" else F.col(c) for c, t in counts.dtypes]
    write_jsonl(counts.select(*safe).coalesce(1), path)


def write_documents(df: DataFrame, path: str, document: str = "document") -> None:
    """A curated copy, a folder a document."""
    df.repartition(document).write.mode("overwrite").partitionBy(document).parquet(path)


def one_mode(**modes: object) -> str:
    """The one input mode that is given."""
    given = [k for k, v in modes.items() if v]
    if len(given) != 1:
        raise ValueError(f"exactly one of {sorted(modes)} must be given, not {given}")
    return given[0]


def read_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Tables from a path each; all required ones must be there."""
    absent = [n for n in REQUIRED if n not in paths]
    if absent:
        raise ValueError(f"no path for {absent}")
    return {n: conform(read_csv(spark, p), n) for n, p in paths.items()}


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def download_state(exists_: Column, old: Column, new: Column) -> Column:
    """downloaded, unchanged, updated or failed, from whether a file was there and the checksums before and after."""
    return F.when(new.isNull(), "failed").when(~exists_, "downloaded").when(old == new, "unchanged").otherwise("updated")
