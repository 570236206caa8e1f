"""The corpus pipeline: toxic and low-quality documents go, one of each group of near copies stays, the rest is packed.

Every stage works on all that the one before kept. Null and empty texts fail the quality rules and go there; very long texts
are read, compared and packed whole. Of rows that are equal or near copies one stays, that of the least doc_id (a null one
only where there is no other); rows that share a doc_id are judged one by one. Scores equal to a cut are on its upper side.
Columns beyond those of documents pass through all stages but the last, whatever their names. Empty tables give no rows;
without labels of both kinds nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import bagminhash, packing, rules, toxicity
from lanewise.llm.common import drop, staged, table, tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_by_rules(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.packed(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]
#: The first stage's model and the third's signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one keeps is written and read again as the next one's input, and what was written
    before that is deleted. The last stage's tables stay for whoever reads the result."""
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with tables() as written:
            docs = staged(stage(spark, docs, sf_dir), name)
        drop(spark, old + written[:-1])
        old = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
