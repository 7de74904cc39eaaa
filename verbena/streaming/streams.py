"""The stateless pipeline on streams, and windowed transitions of event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pipeline import Pipeline


def read_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def clean_stream(stream: DataFrame, pipeline: Pipeline) -> DataFrame:
    """The same projection as for a table; no state."""
    return pipeline.fit_transform(stream)


def event_counts(stream: DataFrame, time: str, event: str, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows (start, event, n) of tumbling windows; events later than the watermark are dropped, and closed windows leave the state."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(event).alias("event"))
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event", "n")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write all that is there as Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
