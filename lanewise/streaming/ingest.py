"""Bundles as they arrive: a file stream of result lines, parsed and appended once.

The batch path reloads whole folders; here new files are picked up by the stream's checkpoint, each micro-batch is parsed
with the same expressions under the event header above each line, its keys are made unique, and keys that the core table
has already are left out. A batch that is run again after a failure adds nothing. A file is one document, read as one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanewise.operators import core
from lanewise.plans import documents

KEYS = ["document", "event", "rank", "name", "time_ms"]


def parsed(texts: DataFrame) -> DataFrame:
    """The result lines of (document, text), with the event they stand under."""
    rows = documents.parsed_documents(documents.lines(texts, "document", "text"), ["document"], ["line_number"])
    return rows.where("kind <> 'header' AND result IS NOT NULL").select("document", "event", "result.rank", "result.name", "result.team", "result.time_ms", "result.status")


def start(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Reads text files of `folder` as they come and keeps the Parquet table `target`, a folder a document, free of repeats.

    A batch reads the folders of its own documents only, and replaces them by what they had and what is new, so a batch
    that failed half-way and runs again leaves the same table.
    """
    texts = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("text"))

    def load(batch: DataFrame, _: int) -> None:
        new = core.first_by(parsed(batch), KEYS, F.asc("team"), F.asc("status"))
        try:
            known = spark.read.schema(new.schema).parquet(target).join(new.select("document").distinct(), "document", "left_semi").select(*new.columns)
            new = known.unionByName(core.missing_from(new, known, KEYS))
        except Exception as error:  # the first batch has no table yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new = new.checkpoint() if core.df_has_checkpoint(new) else new
        new.write.mode("overwrite").partitionBy("document").option("partitionOverwriteMode", "dynamic").parquet(target)

    stream = texts.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events a window and type; rows later than `late` are left out of a stream, and a batch counts them all."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")
