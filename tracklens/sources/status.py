"""The status of every game's processing, as a versioned table: attempts are added, costs are not lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versioned import VersionedTable

ATTEMPT = "struct<at:long,returncode:string,seconds:long,cost:double>"
STATUS = f"game string, at long, status string, home_check string, cost double, attempts array<{ATTEMPT}>"


def merged(rows: DataFrame) -> DataFrame:
    """One row a game of old and new ones (columns of STATUS): the latest status and home check that are not null, the
    last known cost, and all attempts in order, each once."""
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    attempts = F.sort_array(F.array_distinct(F.flatten(F.collect_list("attempts")))).alias("attempts")
    return rows.groupBy("game").agg(F.max("at").alias("at"), latest("status"), latest("home_check"), latest("cost"), attempts).select("game", "at", "status", "home_check", "cost", "attempts")


class StatusTable:
    """Status records by game, at a path that all drivers share."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)

    def record(self, results: DataFrame) -> int:
        """Adds results (game, at, status, home_check, returncode, seconds, cost). One without a return code is no
        attempt. A cost that is null leaves the known one."""
        attempt = F.struct("at", "returncode", F.col("seconds").cast("long").alias("seconds"), F.col("cost").cast("double").alias("cost")).cast(ATTEMPT)
        attempts = F.when(F.col("returncode").isNotNull(), F.array(attempt)).otherwise(F.array().cast(f"array<{ATTEMPT}>"))
        rows = results.select("game", F.col("at").cast("long").alias("at"), "status", "home_check", F.col("cost").cast("double").alias("cost"), attempts.alias("attempts"))
        return self.table.upsert(merged(rows), ["game"], lambda both: merged(both.drop("_new")))

    def read(self) -> DataFrame:
        return self.table.read() if self.table.version() else self.table.spark.createDataFrame([], STATUS)

    def spent(self) -> float:
        """What all attempts have cost so far."""
        return self.read().select(F.explode("attempts").alias("a")).agg(F.coalesce(F.sum("a.cost"), F.lit(0.0))).first()[0]

    def todo(self, games: DataFrame, *, again: bool = False) -> DataFrame:
        """The games that have no status `done` (all, with `again`) and no home check that failed."""
        known = self.read().select("game", "status", "home_check")
        fine = ~F.coalesce(F.col("home_check") == "mismatch", F.lit(False))
        return games.join(known, "game", "left").filter(fine & (F.lit(again) | ~F.coalesce(F.col("status") == "done", F.lit(False)))).drop("status", "home_check")
