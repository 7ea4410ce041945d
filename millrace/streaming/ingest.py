"""Incremental ingestion: new files of nested cases are taken up once, in whole batches, with the stream's own checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import elements


def ingest_new_files(spark: SparkSession, folder: str, warehouse: str, checkpoint: str, source: str = "files") -> None:
    """Takes up what has come into the folder since the last call and ends. Each batch is one commit that also holds the batch's number,
    so a batch that is repeated after a failure is known and left out. Cases that cannot be read, and files that end in the middle, go into
    rejects; they do not stop the stream."""
    wh = ingest.Warehouse(spark, warehouse)

    def take(batch: DataFrame, number: int) -> None:
        found, broken = elements.split(batch, "cases")
        raw, unparsed = ingest.parsed(found)
        good, bad = ingest.checked(raw)
        broken = broken.select(F.regexp_extract("file", "[^/]*$", 0).alias("id"), "error")
        failed = bad.unionByName(unparsed).unionByName(broken)
        ingest.run(wh, *ingest.flatten(good), source=source, checkpoint_key=source, failed=failed, batch=(checkpoint, number))

    stream = spark.readStream.format("text").option("lineSep", "}").load(folder)
    stream = stream.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", streaming: bool = True) -> DataFrame:
    """Events by type and window of event time. In a stream each id counts once, and events later than the watermark are left
    out."""
    if streaming:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
