"""Monthly downloads as a stream: new envelope files are normalised and upserted batch by batch (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedupe import upsert
from ..plans.normalise import normalise


def envelope_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The bodies of envelope files as they arrive."""
    return spark.readStream.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).text(path).select(F.col("value").alias("body"))


def upsert_batches(target: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch as a new version of the table; a batch that is run again writes the same version again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = normalise(batch)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 1}")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = upsert(spark.read.parquet(f"{target}/v={number - 1}"), new, "id")
        new.write.mode("overwrite").parquet(f"{target}/v={number}")

    return write


def run_monthly(spark: SparkSession, path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start the stream: all files there are, then it ends."""
    return envelope_stream(spark, path).writeStream.foreachBatch(upsert_batches(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events per window and kind, late ones counted until the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
