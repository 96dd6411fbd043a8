"""Small functions of reports, pages, files and the court, each on a few rows with known results."""

import json

import pytest
from pyspark.sql import functions as F

from tracklens.functions import court as C
from tracklens.functions import text as X
from tracklens.operators import display as D
from tracklens.operators import halfcourt as H
from tracklens.operators import reports as R
from tracklens.plans import jobs, spec
from tracklens.sources import files as S


def values(spark, expression, schema, *rows):
    """The value of a column over rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    return [r["v"] for r in df.select("_i", expression.alias("v")).orderBy("_i").collect()]


def test_times_and_landmarks(spark):
    assert values(spark, C.time_grid(F.col("a"), F.col("b"), F.lit(10.0)), "a double, b double", (1.0, 1.5), (2.0, 2.0)) == [[1.0, 1.1, 1.2, 1.3, 1.4], []]
    sampled = values(spark, C.sample_indices(F.col("s"), F.col("t"), F.col("a"), F.col("b")), "s double, t double, a double, b double", (60.0, 10.0, 0.0, 0.5), (30.0, 60.0, 0.0, 0.1), (0.0, 10.0, 0.0, 1.0), (60.0, 10.0, 2.0, 1.0))
    assert sampled == [[0, 6, 12, 18, 24], [0, 1, 2], [], []]
    assert [tuple(r)[1:] for r in C.landmark_table(spark).orderBy("landmark").collect()] == [tuple(map(float, v)) for v in spec.landmarks()]


def test_labels_and_names(spark):
    label = X.track_label(F.col("team"), F.col("jersey"), F.col("name"), F.col("id"))
    assert values(spark, label, "team string, jersey string, name string, id int", ("Reds", "5", "Ann Lee", 1), ("Reds", "5", None, 2), ("Reds", None, None, 3), (None, None, None, 4)) == ["RED #5 Lee", "RED #5", "RED id3", "? id4"]
    clip = X.clip_name(F.col("i"), F.col("s"), F.col("team"), F.col("o"))
    assert values(spark, clip, "i int, s double, team string, o string", (7, 83.9, "North State", "made_2"), (12, 5.0, None, None)) == ["p007_0083s_north-state_made_2", "p012_0005s_unknown"]
    regions = values(spark, X.region_map(F.col("s")), "s string", ("clock=1,2,3,4;away= 5, 6,7,8",))[0]
    assert regions == {"clock": [1, 2, 3, 4], "away": [5, 6, 7, 8]}
    assert values(spark, S.video_url(F.col("y")), "y string", ("abcdefghijk",))[0].endswith("watch?v=abcdefghijk")


def test_rosters(spark):
    players = spark.createDataFrame([("Reds", "30", "Bo"), ("Reds", "5", "Ann"), ("Reds", "00", "Cy"), ("Reds", "x", "Di"), ("Blues", "1", "Ed"), ("Blues", "1", "Ed")], "team string, jersey string, name string")
    assert D.roster_names(players).first()["names"] == ["Ann", "Bo", "Cy", "Di", "Ed"]
    assert {r["team"]: r["flag"] for r in D.team_flags(players).collect()} == {"Reds": "Reds:00,5,30,x", "Blues": "Blues:1"}
    assert values(spark, D.on_one_roster(F.col("a"), F.col("b")), "a boolean, b boolean", (True, False), (False, True), (True, True), (False, False)) == [0, 1, None, None]
    crops = spark.createDataFrame([("g", 0, 10.0), ("g", 0, 30.0), ("g", 1, None)], "game string, cluster int, value double")
    assert {r["cluster"]: r["brightness"] for r in D.mean_brightness(crops, ["game", "cluster"], "value").collect()} == {0: 20.0, 1: 0.0}
    spans = spark.createDataFrame([("g", 2, 10.0, 20.0), ("g", 1, 0.0, 10.0)], "game string, period int, t_lo double, t_hi double")
    assert json.loads(D.spans_json(spans).first()["spans"]) == [{"period": 1, "t_lo": 0.0, "t_hi": 10.0}, {"period": 2, "t_lo": 10.0, "t_hi": 20.0}]


def test_reports(spark):
    games = spark.createDataFrame([("a", "done", 2.5), ("b", "pending", None), ("c", "flagged", 1.0)], "game string, status string, cost double")
    totals = R.corpus_totals(games).first()
    assert (totals["done"], totals["games"], totals["cost"]) == (2, 3, 3.5)
    assert R.corpus_totals(games.limit(0)).first()["cost"] == 0.0
    table = R.markdown_table(games.select("game", "cost"), {"cost": "%.2f"}, ["game"]).split("\n")
    assert table == ["| game | cost |", "|---|---|", "| a | 2.50 |", "| b |  |", "| c | 1.00 |"]
    pairs = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", None, 2), ("b", 3, 3)], "game string, p int, q int")
    assert {r["game"]: (r["agree"], r["disagree"]) for r in R.agreement(pairs, ["game"], "p", "q").collect()} == {"a": (1, 1), "b": (1, 0)}
    registry = spark.createDataFrame([(1, "x", "holdout", "2024-01-01"), (2, "x", "train", "2024-03-01"), (3, "y", "train", "2024-02-01"), (4, "x", "train", "2024-01-15")], "ord int, layout string, split string, date string")
    assert [r["ord"] for r in R.ordered_games(registry).collect()] == [1, 3, 4, 2]
    costs = spark.createDataFrame([(1, 4.0), (2, 3.0), (3, 2.0)], "ord int, estimate double")
    assert [(r["spent"], r["runs"]) for r in R.cost_gate(costs, 7.0).orderBy("ord").collect()] == [(4.0, True), (7.0, True), (9.0, False)]
    frames = spark.createDataFrame([("g", 8, True, False, True), ("g", 10, False, False, True)], "game string, n_players int, fitted boolean, shot boolean, has_ball boolean")
    assert tuple(R.raw_stats(frames).first()) == ("g", 2, 9.0, 0.5, 0.0, 1.0)


def test_possession_summaries(spark):
    kind = "possession_id int, start_time double, end_time double, offense_team string, attacking_basket string, clock_start double, clock_end double, outcome string, points_scored int, players array<struct<name:string>>, events array<struct<clock:double,text:string>>"
    df = spark.createDataFrame([(1, 1.26, 9.0, "Reds", "left", 723.0, 59.4, "made_2", 2, [("Bo",), (None,), ("Ann",), ("Bo",)], [(700.0, "Ann makes layup")]), (2, 0.0, 1.0, None, "right", None, None, None, None, [], None)], kind)
    a, b = R.possession_summary(df).orderBy("possession_id").collect()
    assert (a["start"], a["clock_start"], a["players"], a["events"]) == (1.3, "12:03", "Ann; Bo", "11:40 Ann makes layup")
    assert b["players"] == "" and b["events"] == "" and b["clock_start"] is None


def test_labels_and_validation(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", "man"), ("b", "holdout", "zone"), ("c", "holdout", "man")], "key string, split string, predicted string")
    held, all_of_them = R.validation_rows(rows, F.col("split"))
    assert {r["key"] for r in held.collect()} == {"b", "c"} and not all_of_them
    assert R.validation_rows(rows.filter("split = 'train'"), F.col("split"))[1]
    progress = R.label_progress(spark.createDataFrame([("b", "zone"), ("c", "zone")], "key string, label string"), held).first()
    assert (progress["done"], progress["total"], progress["agree"]) == (2, 2, 1)
    path = str(tmp_path / "labels")
    assert S.load_labels(spark, path).first().asDict() == {"clusters": {}, "validation": {}, "defense": {}, "version": 1}
    S.save_labels(spark.createDataFrame([({"2": "horns", "1": "box"}, {}, {"g:1:0": "man"}, 3)], spec.LABELS), path)
    found = S.load_labels(spark, path).first()
    assert found["clusters"] == {"1": "box", "2": "horns"} and found["defense"] == {"g:1:0": "man"} and found["version"] == 3
    texts = spark.createDataFrame([('{"a": 3, "b": {"cluster": 4, "distance": 1.5}}',)], "j string").select(F.expr("parse_json(j)").alias("v"))
    one = lambda key: R.normalized_assignments(F.variant_get("v", f"$.{key}", "variant"))
    r = texts.select(one("a").alias("a"), one("b").alias("b")).first()
    assert tuple(r["a"]) == (3, None) and tuple(r["b"]) == (4, 1.5)


def test_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"t": 1.0, "clock": "NaN", "clock_text": null, "away": 1, "home": 2}\n{"t": 2.0, "clock": 30.5, "clock_text": "30.5", "away": null, "home": 2}\n')
    assert [(r["t"], r["clock"]) for r in S.read_timeline(spark, str(tmp_path / "t.jsonl")).orderBy("t").collect()] == [(1.0, None), (2.0, 30.5)]
    (tmp_path / "records").mkdir()
    for name, rows in (("a.jsonl", [("g", 1, 0, "old"), ("g", 1, 1, "x"), ("g", 1, 0, "newer")]), ("b.jsonl", [("g", 1, 1, "last"), ("g", 2, 0, "y")])):
        (tmp_path / "records" / name).write_text("\n".join(json.dumps(dict(zip(("game_id", "period", "index", "v"), r))) for r in rows))
    raw = spark.read.schema("game_id string, period int, index int, v string").json(str(tmp_path / "records"))
    assert {r["key"]: r["v"] for r in S.read_records(raw).collect()} == {"g:1:0": "newer", "g:1:1": "last", "g:2:0": "y"}
    assert {r["key"]: r["v"] for r in S.read_records(raw, order="v").collect()}["g:1:0"] == "old"
    spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, vector array<double>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int").write.parquet(str(tmp_path / "i"))
    spark.createDataFrame([("a", 1)], "key string, n int").write.parquet(str(tmp_path / "short"))
    assert {r["key"]: (r["vector"], r["n"]) for r in S.read_feature_rows(spark, str(tmp_path / "v"), str(tmp_path / "i")).collect()} == {"a": ([1.0], 1), "b": ([2.0], 2)}
    with pytest.raises(ValueError, match="differ in rows"):
        S.read_feature_rows(spark, str(tmp_path / "v"), str(tmp_path / "short"))
    game = {"espn_id": "1", "youtube_id": "abcdefghijk", "date": "2024-01-02", "opponent": "X", "home": True, "broadcaster": "B", "layout": "a", "split": "train", "note": ""}
    (tmp_path / "games.json").write_text(json.dumps([game, game | {"espn_id": "2"}]))
    games = S.read_registry(spark, str(tmp_path / "games.json"), ["a"])
    assert S.get_game(games, "2").count() == 1
    with pytest.raises(KeyError):
        S.get_game(games, "3")
    (tmp_path / "bad.json").write_text(json.dumps([game | {"layout": "zz"}]))
    with pytest.raises(Exception, match="unknown layout"):
        S.read_registry(spark, str(tmp_path / "bad.json"), ["a"]).collect()
    for g in ("1", "2"):
        S.write_jsonl(spark.createDataFrame([(g, 1)], "g string, n int"), S.game_path(str(tmp_path / "corpus"), g, "rows.jsonl"))
    assert {r["g"] for r in S.corpus_of(spark, str(tmp_path / "corpus"), ["1", "2"], "rows.jsonl", "g string, n int").collect()} == {"1", "2"}


def test_scope_and_changed_spans(spark):
    rows = [("ato", True, False, 1.0), ("dead", True, False, None), ("live", True, False, 1.0), ("dead", False, False, 1.0), ("dead", True, True, 1.0)]
    df = spark.createDataFrame(rows, "start_type string, located boolean, transition boolean, t0 double")
    assert df.filter(H.in_scope()).count() == 1
    a = spark.createDataFrame([("g", 1, 0.0, 10.0), ("g", 2, 10.0, 20.0)], "game string, period int, t_lo double, t_hi double")
    b = spark.createDataFrame([("g", 1, 0.0, 10.0), ("g", 2, 11.0, 20.0)], a.schema)
    assert {(r["side"], r["t_lo"]) for r in jobs.changed_spans(a, b).collect()} == {("old", 10.0), ("new", 11.0)} and jobs.changed_spans(a, a).isEmpty()


def test_runs_over_chunks(spark):
    """However the rows are cut, the histogram is that of the whole."""
    import random

    from tracklens.operators import windows as W

    rng = random.Random(5)
    rows = [(g, i, rng.random() < p) for g, p, n in (("a", 0.6, 200), ("b", 0.97, 150), ("c", 1.0, 40), ("d", 0.0, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "game string, i int, ok boolean")
    want = {(r["game"], r["n"]): r["c"] for r in W.runs_of_true(df, key="game", order="i", flag=F.col("ok")).groupBy("game", "n").agg(F.count("*").alias("c")).collect()}
    for size in (1, 7, 50, 1000):
        cut = W.chunk_runs(df.withColumn("chunk", F.floor(F.col("i") / size)), keys=["game"], chunk="chunk", order="i", flag=F.col("ok"))
        assert {(r["game"], r["n"]): r["times"] for r in W.merged_runs(cut, keys=["game"], chunk="chunk").collect()} == want
    assert want["c", 40] == 1 and not any(g == "d" for g, _ in want)


def test_summaries_through_the_cache(spark, tmp_path):
    """What is cached is not fetched again; a filter reads one folder."""
    root, asked = str(tmp_path / "cache"), []
    plays = "array(named_struct('clock', named_struct('displayValue', '1:00'), 'text', game_id, 'team', named_struct('id', '1'), 'type', named_struct('text', 'x'), 'scoringPlay', false, 'scoreValue', 0, 'period', named_struct('number', 1), 'awayScore', 0, 'homeScore', 0))"

    def fetch(ids):
        asked.append(sorted(r["game_id"] for r in ids.collect()))
        empty = spark.createDataFrame([], "game_id string, " + spec.SUMMARY).select("game_id", "header", "boxscore")
        return empty.unionByName(ids.select("game_id"), allowMissingColumns=True).selectExpr("game_id", "header", "boxscore", f"{plays} plays")

    ask = lambda *ids: S.cached_summaries(spark, root, spark.createDataFrame([(i,) for i in ids], "game_id string"), fetch)
    assert {r["game_id"]: r["plays"][0]["text"] for r in ask("g1", "g2").collect()} == {"g1": "g1", "g2": "g2"}
    assert {r["game_id"] for r in ask("g2", "g3").collect()} == {"g2", "g3"} and asked == [["g1", "g2"], ["g3"]]
    one = spark.read.schema("plays array<struct<text:string>>, game_id string").json(root).filter("game_id = 'g1'")
    assert one.count() == 1 and all("game_id=g1" in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(game_id" in one._jdf.queryExecution().toString()
    assert ask("g1").collect()[0]["plays"][0]["text"] == "g1" and len(asked) == 2
