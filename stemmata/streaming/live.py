"""Online operators: incremental labelling, and windowed activity with late rows.

The batch engine needs neither; they serve a log that grows while it is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import labelled
from ..sources.runs import append_labels


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def activity(events: DataFrame, at: str, who: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """who, start, events: counts by tumbling window; rows later than `late` are left to the batch run."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    return timed.withWatermark("_at", late).groupBy(who, F.window("_at", window).alias("w")).count().select(who, F.col("w.start").alias("start"), F.col("count").alias("events"))


def label_as_they_come(lines: DataFrame, store: str, key: str, text: str, labeler: Callable[[str], str], checkpoint: str) -> StreamingQuery:
    """Labels each new distinct line once: every batch is reduced by the store before the labeler sees it."""

    def each(batch: DataFrame, _: int) -> None:
        rows = labelled(batch.select(key, text).dropDuplicates([key]), labeler, text)
        append_labels(batch.sparkSession, store, rows, [key])

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
