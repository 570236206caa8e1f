"""A bounded sample of labelled documents, and scores next to their documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanewise.llm.common import held_out, staged


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text", class_bytes: int = 32 << 20) -> DataFrame:
    """(text, label) of at most `per_class` labelled keys of each class, and of texts of at most `class_bytes` bytes together,
    none of them held out: one row a key and class.

    Keys are taken in the order of their hash, so ties can't be and the order of rows doesn't matter. They are bounded, so
    they are broadcast; of a key's documents the one with the least hash of its text is taken, and tasks shuffle one text a
    key and class at most. Of the texts so found, those count whose running length in that order stays within
    `class_bytes`; texts over a sixteenth of it come last. A key labelled both ways counts in both classes; null keys, null
    labels and labels but 0 and 1 don't count.
    """
    own = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).where(F.col("k").isNotNull() & ~held_out("k")).distinct()
    some = None
    for value in (0, 1):
        part = own.where(F.col("label") == value).orderBy(F.xxhash64("k"), "k").limit(per_class)
        some = part if some is None else some.union(part)
    slim = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    one = F.min_by("text", F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("text")
    found = staged(slim.join(F.broadcast(some), "k").groupBy("k", "label").agg(one).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "sample")
    turn = Window.partitionBy("label").orderBy(16 * F.col("size") > class_bytes, F.xxhash64("k"), "k")  # numbers of bounded rows only
    kept = found.select("k", "label", F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, 0)).alias("upto")).where(F.col("upto") <= class_bytes)
    return found.join(F.broadcast(kept.select("k", "label")), ["k", "label"]).select("text", "label")


def with_scores(docs: DataFrame, text: str, score: Callable[[pa.Array], np.ndarray], into: str, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all, by default) and a double `into` that score() gives for the texts."""
    carry = docs.columns if carry is None else carry
    carry = [c for c in carry if c != into]
    names = list(dict.fromkeys([*carry, text]))
    slim = docs.select(*names)
    at = names.index(text)
    schema = T.StructType([*[f for f in slim.schema if f.name in carry], T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(names.index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score(batch.column(at)), pa.float64())], names=[*carry, into])

    return slim.mapInArrow(run, schema)
