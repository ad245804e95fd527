"""Streams: slabs that wait for all their blocks, live planes, and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def complete_slabs(planes: DataFrame, n_blocks: int, ttl: str | None = None) -> DataFrame:
    """From a stream of (slab, block, n), one row (slab, blocks, n) for each slab once all blocks have come.

    State is a slab's set of blocks and its running sum. A block that comes twice counts once. With ``ttl``
    (a Spark timeout duration), a slab whose blocks stop coming is forgotten.
    """

    def collect(key, frames: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        seen, total, done = state.get if state.exists else ("", 0, False)
        blocks = set(filter(None, seen.split(",")))
        for pdf in frames:
            for b, n in zip(pdf.block.astype(str), pdf.n):
                if b not in blocks:
                    blocks.add(b)
                    total += int(n)
        emit = len(blocks) >= n_blocks and not done
        state.update((",".join(sorted(blocks)), total, done or emit))
        if ttl:
            state.setTimeoutDuration(ttl)
        if emit:
            yield pd.DataFrame({"slab": [key[0]], "blocks": [len(blocks)], "n": [total]})

    timeout = "ProcessingTimeTimeout" if ttl else "NoTimeout"
    return planes.groupBy("slab").applyInPandasWithState(collect, "slab long, blocks long, n long", "seen string, total long, done boolean", "append", timeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and give its rows, written by batch beside the checkpoint.

    Each batch writes a folder of its own, so one that runs again replaces its rows. In complete mode the last batch is the
    result.
    """
    path, spark = f"{checkpoint.rstrip('/')}-{name}", stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if mode == 'complete' else number}")

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):  # a stream without a batch
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("basePath", path).parquet(path).select(*stream.columns)


def live_planes(stream: DataFrame, path: str, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None):
    """Write each finished channel's plane to its own partition; a batch that runs again overwrites its own only."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chan").parquet(path)
        if also:
            also(batch, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1, name: str = "events*.parquet") -> DataFrame:
    """Events as a stream; back-pressure is the number of files a batch."""
    files = spark.read.option("pathGlobFilter", name)
    schema = files.parquet(folder).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    t = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return t.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    t = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return t.select("user_id", F.col("w.start").alias("start"), "n")
