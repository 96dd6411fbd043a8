"""From frames to the page as a graph of stored tables: a change in one source reruns what reads it, and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import halfcourt as H
from ..operators import possessions as P
from ..operators import reports as R
from ..operators.scoreboard import clean_periods
from ..operators.states import period_spans
from .graph import JobGraph, Step

SOURCES = ("frames", "reads", "plays", "rosters", "names")


def _extract(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return P.build_possessions(t["frames"], t["rosters"], t["names"], spans=t["spans"])


def _records(team: str):
    def make(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
        reads = t["clean"].select("game", "t", "clock").dropDuplicates(["game", "t"])
        return {"records": H.build_records(t["plays"], reads, t["spans"], t["possessions"], t["points"], team=team)}

    return make


def _coverage(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    by_game = R.period_coverage(t["records"], ["game"])
    return {"coverage": by_game.withColumn("start_types", F.map_entries("start_types"))}


def _page(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    shown = t["records"].filter(F.col("located")).join(t["coverage"].select("game", F.struct("intervals", "located").alias("coverage")), "game")
    return {"page": R.page_payload(shown)}


def refresh_graph(spark: SparkSession, path: str, *, team: str) -> JobGraph:
    """The steps for the records and the page of one team, over the tables SOURCES: frames and names as for
    build_possessions, reads (game, t, clock, clock_text, away, home) and plays as for build_records."""
    return JobGraph(
        spark,
        path,
        [
            Step("spans", ("reads",), ("spans",), lambda t: {"spans": period_spans(t["reads"], keys=["game"])}),
            Step("clean", ("reads", "spans"), ("clean",), lambda t: {"clean": clean_periods(t["reads"], t["spans"])}),
            Step("extract", ("frames", "rosters", "names", "spans"), ("possessions", "points"), _extract),
            Step("records", ("plays", "clean", "spans", "possessions", "points"), ("records",), _records(team)),
            Step("coverage", ("records",), ("coverage",), _coverage),
            Step("page", ("records", "coverage"), ("page",), _page),
        ],
    )
