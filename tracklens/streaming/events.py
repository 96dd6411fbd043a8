"""Structured Streaming forms of the event-time operators, over any streaming source."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_folder


def event_stream(spark: SparkSession, path: str, schema, name: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    return reader.parquet(path)


def with_watermark(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, *, keys: list[str], ts: str = "ts", width: str = "1 day", value: str = "value") -> DataFrame:
    g = events.groupBy(F.window(ts, width).alias("_w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("_w.start").alias("start"), *keys, "n", F.round("total", 4).alias("total"))


def sliding(events: DataFrame, *, keys: list[str], ts: str = "ts", width: str = "2 days", step: str = "1 day") -> DataFrame:
    g = events.groupBy(F.window(ts, width, step).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("_w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, *, keys: list[str], ts: str = "ts", gap: str = "12 hours") -> DataFrame:
    g = events.groupBy(F.session_window(ts, gap).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *keys, "n")


def first_seen(events: DataFrame, *, keys: list[str], ts: str = "ts") -> DataFrame:
    """Repeats within the watermark are dropped."""
    return events.dropDuplicatesWithinWatermark(keys)


def latest_by_key(events: DataFrame, *, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """For each key the count, the largest value and the last event time so far: a built-in aggregate keeps the state."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.max(value).alias("top"), F.max(ts).alias("last"))


def heartbeat(like: DataFrame, ts: str = "ts", after: str = "1000 days") -> DataFrame:
    """One row of nulls whose event time lies far behind all rows of `like`: it moves the watermark past them, so that
    every window closes and every key ends. It belongs to no key and its own window never closes."""
    row = like.agg(F.max(F.col(ts).cast("timestamp")).alias("_last")).select((F.col("_last") + F.expr(f"INTERVAL '{after}'")).alias("_last"))
    return row.select(*[(F.col("_last") if c == ts else F.lit(None)).cast(k).alias(c) for c, k in like.dtypes])


def in_parts(rows: DataFrame, parts: int, ts: str = "ts") -> list[DataFrame]:
    """rows cut by event time into spans of equal length, in order."""
    low, high = rows.select(F.unix_micros(F.min(F.col(ts).cast("timestamp"))), F.unix_micros(F.max(F.col(ts).cast("timestamp")))).first()
    if low is None:
        return [rows]
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    edges = [low + (high - low) * k // parts for k in range(1, parts)]
    spans = zip([None, *edges], [*edges, None], strict=True)
    return [rows.filter((F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b)) for a, b in spans]


@contextmanager
def rocksdb(spark: SparkSession):
    """State of streams in RocksDB, on local disk with changes in the checkpoint, while the block runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_parts(parts: list[DataFrame], stream: Callable[[DataFrame], DataFrame], *, name: str, end: bool = True, ts: str = "ts") -> DataFrame:
    """What a stream in append mode has written after the parts have come one after another.

    Each part is appended to a folder of Parquet files that the stream reads; then the stream runs until it has read all
    there is, and stops. The next run starts from its checkpoint: state, watermark and the files read already carry over
    from one to the next as they would over a failure. end: a heartbeat comes last.
    """
    spark = parts[0].sparkSession
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    every = [*parts, heartbeat(reduce(DataFrame.unionByName, parts), ts)] if end else parts
    with rocksdb(spark):
        for part in every:
            part.write.mode("append").parquet(f"{root}/source")
            out = stream(event_stream(spark, f"{root}/source", part.schema))
            writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
            writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/rows")


def run_available(df: DataFrame, *, name: str, mode: str) -> DataFrame:
    """Runs a stream over what there is into a Parquet table of the shared folder, and reads it back.

    In mode "complete" and "update" each batch is written to a folder of its own, and the rows have _batch: the newest
    row of a key is that of the largest _batch.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{root}/rows").start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/rows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/_batch={number}")  # again after a failure: the same folder

    writer.foreachBatch(write).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, _batch long").option("basePath", f"{root}/rows").parquet(f"{root}/rows/_batch=*")
    return rows.filter(F.col("_batch") == rows.agg(F.max("_batch")).first()[0]).drop("_batch") if mode == "complete" else rows
