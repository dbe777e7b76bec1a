"""Outcome events as streams: last-wins state, windows and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over event files; ``path`` is a file or a folder, ``files`` the most of them in a batch."""
    reader = spark.readStream.schema(EVENTS)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # as a pattern: a plain path would have to be a folder
    return reader.parquet(f"{path}*")


def last_outcome(stream: DataFrame) -> DataFrame:
    """State per (user_id, step_key): the last event by time, then id."""
    keyed = stream.withColumn("step_key", F.get_json_object("props", "$.k").cast("int"))
    last = keyed.groupBy("user_id", "step_key").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "step_key", "e.event_type", "e.event_id")


def windowed(stream: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and type; rows of windows that ended ``late`` before the watermark are left out."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "events", "total")


def sessions(rows: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap; batch or stream."""
    s = rows.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "events")


def run_to_table(stream: DataFrame, root: str, keys: list[str], buckets: int = 16) -> DataFrame:
    """Runs a stream over what is there, in update mode, and gives its result by key.

    A batch brings only the rows that changed.  They replace the rows of their
    key in the result, a table of ``buckets`` folders by a hash of the key;
    each batch writes a new version of the buckets it touches, under its own
    number, so a batch that is run again after a loss leaves the same result.
    """
    spark = stream.sparkSession
    at = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    current: dict[int, str] = {}

    def merge(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("__bucket", bucket)
        touched = sorted(r[0] for r in fresh.select("__bucket").distinct().collect())  # at most ``buckets``
        if not touched:
            return
        old = [current[b] for b in touched if b in current]
        if old:
            kept = spark.read.schema(stream.schema).parquet(*old)
            fresh = fresh.unionByName(kept.join(batch.select(*keys).distinct(), keys, "left_anti").withColumn("__bucket", bucket))
        target = f"{at}/result-{number}"
        fresh.write.mode("overwrite").partitionBy("__bucket").parquet(target)
        for b in touched:
            current[b] = f"{target}/__bucket={b}"

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(merge).trigger(availableNow=True).start()
    query.awaitTermination()
    if not current:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*current.values())
