"""Resumable work in chunks: what a run that died had finished is kept, and a rerun does only what is missing.

A chunk's rows count once they are in the ledger, a versioned table (chunk, folder) whose commits are atomic; rows of a
chunk that was being written when the run died lie in a folder that the ledger does not name, and are not read. So each
chunk is there once, however often a run is started, and also where two runs do the same chunk at the same time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedTable


class ChunkStore:
    """Rows by chunk at a path that driver and executors share."""

    LEDGER = "chunk string, folder string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ledger = VersionedTable(spark, f"{self.path}/ledger")

    def done(self) -> DataFrame:
        """(chunk, folder) of the finished chunks."""
        return self.ledger.read() if self.ledger.version() else self.spark.createDataFrame([], self.LEDGER)

    def read(self, schema: str) -> DataFrame:
        """All rows of the finished chunks, with a column `chunk`."""
        folders = [f"{self.path}/{r['folder']}" for r in self.done().select("folder").distinct().collect()]  # one a commit
        rows = self.spark.read.schema(f"{schema}, chunk string").parquet(*folders) if folders else self.spark.createDataFrame([], f"{schema}, chunk string")
        own = F.broadcast(self.done().select("chunk", F.col("folder").alias("_folder")))  # one row a chunk
        place = F.regexp_extract(F.input_file_name(), r"/(rows-[0-9a-f]{32})/", 1)
        return rows.withColumn("_place", place).join(own, "chunk").filter(F.col("_place") == F.col("_folder")).drop("_place", "_folder") if folders else rows

    def add(self, rows: DataFrame, chunks: list[str]) -> list[str]:
        """Stores the rows (with a column `chunk`) of the chunks, which may have none, and enters the chunks in the ledger.
        Chunks that another run has entered meanwhile stay as they are. Returns those that are this call's."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        mine = self.spark.createDataFrame([(c, folder) for c in chunks], self.LEDGER)
        self.ledger.change(lambda old: mine if old is None else old.unionByName(mine.join(old.select("chunk"), "chunk", "left_anti")), files=1)
        return sorted(r["chunk"] for r in self.done().filter(F.col("folder") == folder).collect())

    def run(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame], *, chunk: str = "chunk", at_once: int = 8, force: list[str] = ()) -> list[str]:
        """Applies make to the rows of the chunks that are missing (and of those in force, anew), at_once chunks to a
        commit, and returns them. make keeps the column `chunk`."""
        rows = rows.withColumn("chunk", F.col(chunk).cast("string"))
        names = {r["chunk"] for r in rows.select("chunk").distinct().collect()}  # one a chunk, minutes of video each
        if force:
            self.ledger.change(lambda old: self.spark.createDataFrame([], self.LEDGER) if old is None else old.filter(~F.col("chunk").isin(*force)), files=1)
        missing = sorted(names - {r["chunk"] for r in self.done().collect()})
        finished = []
        for i in range(0, len(missing), at_once):
            some = missing[i : i + at_once]
            finished += self.add(make(rows.filter(F.col("chunk").isin(*some))), some)
        return finished

    def sink(self, make: Callable[[DataFrame], DataFrame] = lambda batch: batch, name: str = "batch") -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch: each micro-batch is a chunk, written once also where Spark hands it out again
        after a failure."""

        def write(batch: DataFrame, number: int) -> None:
            key = f"{name}-{number:012d}"
            if self.done().filter(F.col("chunk") == key).isEmpty():
                self.add(make(batch).withColumn("chunk", F.lit(key)), [key])

        return write
