"""Event-time windows on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, with an event time that watermarks accept. The session's zone must be UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    return _counted(stream.withWatermark(at, late), F.window(at, width), keys)


def sliding(stream: DataFrame, at: str, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    return _counted(stream.withWatermark(at, late), F.window(at, width, slide), keys)


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str, late: str) -> DataFrame:
    return _counted(stream.withWatermark(at, late), F.session_window(at, gap), keys)


def _counted(stream: DataFrame, window, keys: list[str]) -> DataFrame:
    n = stream.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def run_to_table(result: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it has written, as a table.

    append adds each batch to a folder of its own number, complete replaces the result; a batch that is run again after a
    failure writes the same folder again, so no row comes twice.
    """
    spark = result.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        target = f"{folder}/out/{'all' if mode == 'complete' else f'batch={number}'}"
        batch.write.mode("overwrite").parquet(target)

    q = result.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
