"""Statistics of texts as they arrive: row-local results, and counts over windows of event time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.tokens import WordSpec
from ..operators.stats import basic_stats, readability_stats
from ..sources.shared import shared_folder


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def live_stats(stream: DataFrame, readability: bool = False, **kw) -> DataFrame:
    """The statistics of each arriving text: a stateless projection, the same as in batch."""
    return readability_stats(stream, **kw) if readability else basic_stats(stream, **kw)


def words_by_window(stream: DataFrame, time_col: str = "added_at", width: str = "1 day", late: str = "7 days", slide: str | None = None, words: WordSpec = WordSpec(), text_col: str = "text") -> DataFrame:
    """Texts and words of each window of event time; a window is final, and its state dropped, once ``late`` has passed."""
    n = F.coalesce(F.size(words.column(F.col(text_col))), F.lit(0))
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    rows = stream.select(time_col, n.alias("n")).withWatermark(time_col, late)
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("texts"), F.sum("n").alias("words")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "texts", "words")


def landed(stream: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there now into a table of its own in the shared folder, and returns that table.

    Rows of a stream without ``keys`` are appended.  One with keys is written in update mode, so state past the
    watermark is dropped; of the rows of a key, written once for each batch that changed it, the last holds.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/part={number}")

    stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    if not keys:
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x")).select(*keys, "x.*")
