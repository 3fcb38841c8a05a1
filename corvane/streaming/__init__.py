"""Comments as a stream: deduplicated within a watermark and appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import squeeze


def deduplicated_stream(comments: DataFrame, *, lateness: str = "30 days") -> DataFrame:
    """The stream with each redelivered comment once, if it comes within `lateness`; state is dropped beyond it."""
    timed = comments.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return timed.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["source_id"]).withColumn("text", squeeze(F.col("text")))


def append_corpus(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come to a Parquet table; restarts go on where the checkpoint stands."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
