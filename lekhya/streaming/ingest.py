"""Streaming: pages into documents and entities, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions import text as T
from lekhya.operators import ner
from lekhya.session import new_folder, ship


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows over the event time."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def run_once(spark: SparkSession, stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a streaming query over all that is available; its last result, from the shared folder."""
    base = new_folder(spark, f"stream-{label}")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of parquet files, or a single file, as a stream."""
    ship(spark)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def ingest(pages: DataFrame) -> DataFrame:
    """Streaming pages to (doc_id, page_number, entity_type, text, normalized, start, end): clean, then extract."""
    cleaned = pages.filter(F.length("text") > 0).select("doc_id", "page_number", T.clean(F.col("text")).alias("text"))
    return ner.extract(cleaned).select("doc_id", "page_number", "entity_type", "text", "normalized", "start", "end")
