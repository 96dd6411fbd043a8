"""Frames to page on a synthetic game; a changed source reruns only what reads it."""

import json

import pytest
from pyspark.sql import functions as F
from test_pipeline import frames

from tracklens.plans.refresh import refresh_graph
from tracklens.sources import files as S


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("refresh") / "frames_00.jsonl"
    path.write_text("\n".join(json.dumps(f) for f in frames()))
    rows = [(0, 1200.0, "Reds", "Jumpball", "Jump Ball won by Reds", False, 0), (1, 1194.0, "Reds", "LayUpShot", "Ann Lee makes layup", True, 2), (2, 1181.0, "Blues", "JumpShot", "Bo Ray misses jumper", False, 0), (3, 1180.0, "Reds", "Defensive Rebound", "Ann Lee defensive rebound", False, 0), (4, 0.0, None, "End Period", "End", False, 0)]
    return {
        "frames": S.read_frames(spark, str(path)).withColumn("game", F.lit("g")).drop("source_file"),
        "reads": spark.createDataFrame([("g", float(t), 1200.0 - t, None, 0, 0 if t < 6 else 2) for t in range(0, 21)], "game string, t double, clock double, clock_text string, away int, home int"),
        "plays": spark.createDataFrame([("g", 1, *r) for r in rows], "game string, period int, seq int, clock double, team string, type string, text string, scoring boolean, score_value int"),
        "rosters": spark.createDataFrame([("g", "Reds", "5", "Ann Lee"), ("g", "Blues", "7", "Bo Ray")], "game string, team string, jersey string, name string"),
        "names": spark.createDataFrame([("g", "Reds", "Blues", 0)], "game string, home string, away string, home_cluster int"),
    }


def test_from_frames_to_the_page(spark, sources, tmp_path):
    graph = refresh_graph(spark, str(tmp_path / "g"), team="Reds")
    assert graph.run(sources, dry=True).ran == ["spans", "clean", "extract", "records", "coverage", "page"]
    assert graph.run(sources).ran == ["spans", "clean", "extract", "records", "coverage", "page"]
    pages = {r["key"]: json.loads(r["json"]) for r in graph.read("page").collect()}
    first = pages["g:1:0"]
    assert first["located"] and first["outcome"] == "made_2" and first["coverage"]["intervals"] == 2
    assert [p.get("name") for p in first["players"]].count("Ann Lee") == 1
    assert graph.read("coverage").first()["located"] == len(pages)

    assert graph.run(sources).ran == []
    renamed = sources | {"rosters": sources["rosters"].withColumn("name", F.when(F.col("jersey") == "5", "Ann Li").otherwise(F.col("name")))}
    report = graph.run(renamed)
    # The roster names the points; what the page shows of them changes, the coverage comes out as before.
    assert report.ran == ["extract", "records", "coverage", "page"] and report.fresh == ["spans", "clean"]
    assert [p.get("name") for p in json.loads(graph.read("page").filter("key = 'g:1:0'").first()["json"])["players"]].count("Ann Li") == 1
    # A player who is not seen: extraction runs, and gives the same tables.
    more = renamed | {"rosters": renamed["rosters"].unionByName(spark.createDataFrame([("g", "Blues", "88", "Cy Doe")], "game string, team string, jersey string, name string"))}
    assert graph.run(more).ran == ["extract"]
    texts = more | {"plays": more["plays"].withColumn("text", F.regexp_replace("text", "misses jumper", "misses three point jumper"))}
    assert graph.run(texts).ran == ["records"]  # of the other team's play: the records stay
