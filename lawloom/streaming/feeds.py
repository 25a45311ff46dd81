"""Structured Streaming twins of the batch merges. Every stream ends by itself (Trigger.AvailableNow), keeps its
checkpoint in the shared folder and can be run again over grown input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.operators import merge
from lawloom.session import shared_dir, written


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet file or directory ``path``; directories are taken one file a batch."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*" if name.endswith(".parquet") else path)


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder; ``release`` deletes it and its checkpoint."""
    path = f"{shared_dir(spark).rstrip('/')}/lawloom-{label}-{uuid.uuid4().hex}"
    written(path, f"{path}-checkpoint")
    return path


def upsert_stream(changes: DataFrame, target: str, keys: list[str], order: list[str], at: str, value: str) -> None:
    """Merge a stream of changes into versions of a table under ``target``: version n+1 holds last value by ``order``,
    first and last time and the number of rows of each key. A batch that runs twice writes the same version twice."""
    spark = changes.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        new = merge.observed_span(batch, keys, at, F.struct(*order, F.col(value).alias("value")), order)
        if n > 0:
            old = batch.sparkSession.read.parquet(f"{target}/version={n - 1}")
            both = old.unionByName(new)
            new = both.groupBy(*keys).agg(F.max_by("last_value", F.struct(*[F.col(f"last_value.{o}") for o in order])).alias("last_value"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen").alias("seen"))
        new.write.mode("overwrite").parquet(f"{target}/version={n}")

    q = changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if spark.read.parquet(target).limit(1).count() == 0:
        raise RuntimeError("the stream wrote no version")


def upserted(spark: SparkSession, path: str, files: int = 3) -> DataFrame:
    """The state after a change log that lands in ``files`` files, so in as many micro-batches."""
    target, landed = _folder(spark, "upsert"), _folder(spark, "landed")
    spark.read.parquet(path).repartitionByRange(files, "ts").write.parquet(landed)
    upsert_stream(read_changes(spark, landed), target, ["user_id", "event_type"], ["ts", "event_id"], "ts", "value")
    versions = spark.read.parquet(target)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).select("user_id", "event_type", F.col("last_value.value").alias("last_value"), "first_seen", "last_seen", "seen")


def daily_counts(spark: SparkSession, path: str, lateness: str = "3 days") -> DataFrame:
    """event_type, day, n, total of a stream of events, late ones by up to ``lateness`` included."""
    target = _folder(spark, "daily")
    events = read_changes(spark, path).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    daily = events.groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    q = daily.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{target}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(target)
    # in update mode a window is written whenever it grew: the last batch that wrote it holds its final counts
    last = out.groupBy("event_type", F.col("window.start").alias("start")).agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return last.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "v.n", F.round("v.total", 4).alias("total"))


def distinct_items(changes: DataFrame, keys: list[str], at: str, lateness: str = "3 days") -> DataFrame:
    """A stream without items seen again within ``lateness``: the streaming form of re-reading the last days."""
    return changes.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
