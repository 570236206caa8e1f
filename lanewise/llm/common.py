"""Reading tables and cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, as in tests, a local session gets a new folder; a cluster
    is told, since its machines share no temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


#: Lists that open tables() blocks fill with the paths written in them.
_open: list[list[str]] = []


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor
    costs no recomputation. The folder may be emptied once the results have been written elsewhere."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _open:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables() -> Iterator[list[str]]:
    """The paths that staged() writes inside the block, in order."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables that nothing reads any more."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def held_out(key) -> F.Column:
    """True for the fold that no model learns from: crc32 of the key's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))

