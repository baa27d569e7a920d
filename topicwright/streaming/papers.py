"""Topic counts of papers that keep arriving, by Structured Streaming.

Each micro-batch of structured texts is parsed on its own, and its counts are
appended to a table under the batch's number. A batch that runs twice (after a
failure) writes the same folder again, so counts stay exact. Spellings meet by
their canonical form; resolution by similarity depends on the order of all names
and belongs to the batch analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import canonical
from ..operators.parse import mentions, parse


def texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc, text) of structured text files as they come in: a row a file."""
    stream = spark.readStream.option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).text(folder)
    return stream.select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("text"))


def batch_counts(batch: DataFrame) -> DataFrame:
    """(key, label, n, marks) of a batch of texts."""
    rows = mentions(parse(batch).questions).withColumn("key", canonical(F.col("raw"))).filter("key <> ''")
    once = rows.groupBy("doc", "paper", "q", "label", "key").agg(F.first("marks").alias("marks"))
    return once.groupBy("key", "label").agg(F.count("*").alias("n"), F.coalesce(F.sum("marks"), F.lit(0.0)).alias("marks"))


def start(stream: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Counts a stream of texts into folders batch=N of table."""

    def write(batch: DataFrame, number: int) -> None:
        batch_counts(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    options = trigger or {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**options).start()


def totals(spark: SparkSession, table: str) -> DataFrame:
    """(key, n, labels, marks) over all batches so far."""
    return spark.read.parquet(table).groupBy("key").agg(F.sum("n").alias("n"), F.count_distinct("label").alias("labels"), F.sum("marks").alias("marks"))
