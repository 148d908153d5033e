"""A stream of documents through the checks that need nothing but the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import sha256
from ..operators import report

SCHEMA = "doc_id long, text string, arrived timestamp"


def documents(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Documents that arrive as JSON lines in a folder."""
    return spark.readStream.schema(schema).json(path)


def first_seen(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Documents whose text has not come within the delay; state older than the watermark is dropped."""
    return stream.withColumn("content_hash", sha256(F.coalesce("text", F.lit("")))).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["content_hash"])


def review(stream: DataFrame, findings_path: str, checkpoint: str) -> StreamingQuery:
    """Review each batch whole, as a document is judged by itself; a batch that is run again
    overwrites its own folder, so that nothing is written twice."""

    def batch(docs: DataFrame, n: int) -> None:
        found = report.deterministic_findings(docs.select("doc_id", "text"))
        found.write.mode("overwrite").parquet(f"{findings_path}/batch={n}")

    return first_seen(stream).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window, documents, words) by arrival; late rows count until the watermark has passed."""
    w = stream.withWatermark("arrived", delay).groupBy(F.window("arrived", window))
    return w.agg(F.count("*").alias("documents"), F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " "))).alias("words"))
