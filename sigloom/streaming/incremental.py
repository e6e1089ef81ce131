"""Streams: class rows labelled against a fixed library, and a cache that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sigloom.operators.detect import Detector


def label_stream(app: DataFrame, detector: Detector, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Labels of a stream of classes (qid, hi, lo, strings), appended as Parquet. A class
    is labelled inside its batch, so no state outlives a batch; a repeated batch writes
    its own folder again."""

    def label(batch: DataFrame, number: int) -> None:
        detector.label(detector.detect(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = app.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def new_observations(spark: SparkSession, cache: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Copies class rows of files that were not there before into ``out``; the stream's
    checkpoint knows which files are done."""
    rows = spark.readStream.schema(schema).json(cache).withColumn("path", F.col("_metadata.file_path"))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
