"""The append-only log as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """A stream of the files of a Parquet folder, or of one file of that name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def without_repeats(stream: DataFrame, keys: list[str], event_time: str, late: str = "180 days") -> DataFrame:
    """The first delivery of each key; state is dropped once the watermark has passed it."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, event_time: str, kind: str, late: str = "180 days") -> DataFrame:
    """day, kind, runs: events per day and kind, late ones up to `late` included; rows without time or kind are left out."""
    rows = stream.where(F.col(event_time).isNotNull() & (F.trim(kind) != "")).withWatermark(event_time, late)
    return rows.groupBy(F.window(event_time, "1 day").alias("w"), F.lower(F.trim(kind)).alias("kind")).agg(F.count("*").alias("runs")).select(F.col("w.start").cast("date").alias("day"), "kind", "runs")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete", each: Callable | None = None) -> None:
    """Process what is there and stop; into a memory table of that name, or through foreachBatch."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(each) if each else w.format("memory").queryName(name)
    w.start().awaitTermination()


def append_unseen(target: str, keys: list[str], schema: str, known: DataFrame | None = None) -> Callable:
    """What foreachBatch runs: the batch's rows whose keys are neither in `known` nor among those written to target, once each, written to a folder of the batch's own.

    A batch that is run again after a failure overwrites its folder, and doesn't see what it wrote before.
    """

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*keys).distinct()
        same = lambda other: [fresh[k].eqNullSafe(other[k]) for k in keys]
        if number > 0:
            written = batch.sparkSession.read.schema(f"{schema}, batch bigint").parquet(target).where(F.col("batch") < number)
            fresh = fresh.join(written, same(written), "left_anti")
        if known is not None:
            fresh = fresh.join(known, [fresh[k].eqNullSafe(known[k]) for k in keys], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each
