"""The steps of a game's ingestion as a graph: what to run, what a forced step invalidates, which gates hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import closure

# Each step and the steps that read its output.
DOWNSTREAM = {
    "download": ["gpu", "ocr"],
    "espn": ["extract", "annotate", "halfcourt"],
    "gpu": ["extract"],
    "ocr": ["extract", "annotate", "halfcourt"],
    "extract": ["annotate", "halfcourt"],
    "annotate": ["halfcourt"],
    "halfcourt": [],
}


class PeriodMismatch(ValueError):
    """The scoreboard shows another number of periods than the play-by-play."""


def forced_steps(spark: SparkSession, force: list[str]) -> list[str]:
    """The forced steps and all that depend on them, in the order of the graph."""
    unknown = set(force) - set(DOWNSTREAM)
    if unknown:
        raise KeyError(sorted(unknown))
    edges = spark.createDataFrame([(a, b) for a, bs in DOWNSTREAM.items() for b in bs], "src string, dst string")
    reached = {r["node"] for r in closure(edges, spark.createDataFrame([(f,) for f in force], "node string")).collect()} if force else set()
    return [s for s in DOWNSTREAM if s in reached]


def run(steps: dict[str, Callable[[], None]], done: set[str], invalid: list[str], *, only: list[str] | None = None, dry_run: bool = False) -> list[str]:
    """Runs what is not done or was invalidated, in order, and returns the names."""
    todo = [s for s in DOWNSTREAM if s in steps and (only is None or s in only) and (s not in done or s in invalid)]
    if not dry_run:
        for s in todo:
            steps[s]()
    return todo


def period_check(spans: DataFrame, plays: DataFrame, *, allow_mismatch: bool = False) -> DataFrame:
    """(game, detected, expected, fine); a mismatch is an error unless allowed."""
    found = spans.groupBy("game").agg(F.max("period").alias("detected"))
    expected = plays.groupBy("game").agg(F.max("period").alias("expected"))
    out = expected.join(found, "game", "left").withColumn("fine", F.col("detected").eqNullSafe(F.col("expected")))
    if not allow_mismatch and not (bad := out.filter("not fine")).isEmpty():
        raise PeriodMismatch(str(bad.first().asDict()))
    return out


def changed_spans(old: DataFrame, new: DataFrame) -> DataFrame:
    """Spans that one side has and the other has not."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))
