"""A synthetic camera over two possessions, from frames to half-court records; files and jobs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracklens.operators import halfcourt as H
from tracklens.operators import possessions as P
from tracklens.plans import jobs, spec
from tracklens.sources import files as S

CAMERA = np.array([[12.0, 0.3, 40.0], [-0.2, 9.0, 30.0], [0.0008, 0.0015, 1.0]])


def seen(x, y):
    p = CAMERA @ [x, y, 1.0]
    return float(p[0] / p[2]), float(p[1] / p[2])


def frames():
    keypoints = [[*seen(x, y), 0.9] for x, y in spec.landmarks()]
    out = []
    for k in range(140):
        left = k < 70
        t, base = round((k if left else k + 60) * 0.1, 3), 20.0 if left else 70.0
        detections = []
        for j in range(10):
            team = j % 2
            x, y = base + 2.0 * (j - 5) + 0.02 * k, 8.0 + 3.5 * j
            px, py = seen(x, y)
            holds = j == (0 if left else 1)
            detections.append({"track_id": j + (0 if left else 100), "cls": 4 if holds else 3, "conf": 0.9, "bbox": [px - 10, py - 60, px + 10, py], "team_cluster": team})
        px, py = seen(base, 25.0)
        detections.append({"track_id": 77, "cls": 8, "conf": 0.9, "bbox": [px - 10, py - 60, px + 10, py], "team_cluster": None})
        numbers = [{"track_id": 0, "text": "5"}] if k % 20 == 0 and left else []
        out.append({"frame_idx": k, "t": t, "keypoints": keypoints, "detections": detections, "ball": None, "numbers": numbers})
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("game") / "frames_00.jsonl"
    path.write_text("\n".join(json.dumps(f) for f in frames()) + "\n\n")
    f = S.read_frames(spark, str(path)).withColumn("game", F.lit("g"))
    rosters = spark.createDataFrame([("g", "Reds", "5", "Ann Lee"), ("g", "Blues", "7", "Bo Ray")], "game string, team string, jersey string, name string")
    names = spark.createDataFrame([("g", "Reds", "Blues", 0)], "game string, home string, away string, home_cluster int")
    return {k: v.persist() for k, v in P.build_possessions(f, rosters, names).items()} | {"rosters": rosters}


def test_two_possessions(built):
    p = built["possessions"].orderBy("start_time").collect()
    assert [(r["attacking_basket"], r["offense_team"]) for r in p] == [("left", "Reds"), ("right", "Blues")]
    assert p[0]["start_time"] == 0.0 and abs(p[0]["end_time"] - 6.9) < 1e-6


def test_tracks_are_where_they_were_seen(built):
    points = built["points"].filter("possession = 1 and track = 4").orderBy("t").collect()
    assert len(points) == 70 and all(r["team"] == "Reds" for r in points)
    assert all(abs(r["x"] - (18.0 + 0.02 * k)) < 0.1 and abs(r["y"] - 22.0) < 0.1 for k, r in enumerate(points))
    assert built["points"].filter("track = 77").count() == 0
    named = built["points"].filter("name is not null").select("track", "name", "jersey", "holding").distinct().collect()
    assert [tuple(r) for r in named] == [(0, "Ann Lee", "5", True)]


def test_json_round_trip(spark, built, tmp_path):
    S.write_jsonl(P.nested(built["possessions"], built["points"]), str(tmp_path / "out"))
    back = S.read_possessions(spark, str(tmp_path / "out")).orderBy("possession_id").collect()
    assert len(back) == 2 and len(back[0]["players"]) == 10 and len(back[0]["players"][0]["trajectory"]) == 70


def test_annotation_and_records(spark, built):
    reads = spark.createDataFrame([("g", float(t), 1200.0 - t, None, 0 if t < 6 else 0, 0 if t < 6 else 2) for t in range(0, 21)], "game string, t double, clock double, clock_text string, away int, home int")
    spans = spark.createDataFrame([("g", 1, 0.0, 30.0)], "game string, period int, t_lo double, t_hi double")
    rows = [(0, 1200.0, "Reds", "Jumpball", "Jump Ball won by Reds", False, 0, 0, 0), (1, 1194.0, "Reds", "LayUpShot", "Ann Lee makes layup", True, 2, 0, 2), (2, 1181.0, "Blues", "JumpShot", "Bo Ray misses jumper", False, 0, 0, 2), (3, 1180.0, "Reds", "Defensive Rebound", "Ann Lee defensive rebound", False, 0, 0, 2), (4, 0.0, None, "End Period", "End", False, 0, 0, 2)]
    plays = spark.createDataFrame([("g", 1, *r) for r in rows], "game string, period int, seq int, clock double, team string, type string, text string, scoring boolean, score_value int, away_score int, home_score int")
    out = P.annotated(built["possessions"], reads, spans, plays, built["rosters"])
    p = {r["possession"]: r for r in out["possessions"].collect()}
    assert p[1]["outcome"] == "made_2" and p[1]["points_scored"] == 2 and p[1]["clock_start"] == 1200.0 and p[2]["outcome"] == "missed_2"
    e = {r["seq"]: r for r in out["events"].collect()}
    assert e[1]["player"] == "Ann Lee" and e[1]["t"] == 6.0 and e[2]["possession"] == 2
    records = {r["key"]: r for r in H.build_records(plays, reads, spans, built["possessions"], built["points"], team="Reds").collect()}
    first = records["g:1:0"]
    assert first["located"] and first["start_type"] == "live" and first["t0"] == 0.0 and first["outcome"] == "made_2" and len(first["players"]) == 5


def test_jobs(spark):
    assert jobs.forced_steps(spark, ["extract"]) == ["extract", "annotate", "halfcourt"]
    ran = []
    steps = {s: (lambda s=s: ran.append(s)) for s in jobs.DOWNSTREAM}
    assert jobs.run(steps, set(jobs.DOWNSTREAM), ["annotate"]) == ["annotate"] == ran
    assert jobs.run(steps, set(), [], dry_run=True) == list(jobs.DOWNSTREAM) and ran == ["annotate"]
    spans = spark.createDataFrame([("g", 1), ("g", 2)], "game string, period int")
    with pytest.raises(jobs.PeriodMismatch):
        jobs.period_check(spans, spark.createDataFrame([("g", 3)], "game string, period int"))


def test_home_check(spark):
    games = spark.createDataFrame([(str(i), "abcdefghijk", "2024-01-02", "X", h) for i, h in ((1, True), (2, False), (3, True), (4, True), (5, None))], "espn_id string, youtube_id string, date string, opponent string, home boolean")
    sides = [(g, s, t) for g in ("1", "2", "5") for s, t in (("home", "Reds"), ("away", "Blues"))] + [("3", "home", "Greens"), ("3", "away", "Blues")]
    teams = spark.createDataFrame(sides, "game_id string, side string, team string")
    assert {r["espn_id"]: r["check"] for r in S.home_check(games, teams, "Reds").collect()} == {"1": "ok", "2": "mismatch", "3": "unknown", "4": "unknown", "5": "unknown"}


def test_empty_source_is_an_error(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("\n")
    with pytest.raises(S.EmptySource):
        S.read_frames(spark, str(tmp_path / "f.jsonl"))


def test_registry_and_summary(spark, tmp_path):
    games = spark.createDataFrame([("1", "abcdefghijk", "2024-01-02", "X", "a", "train"), ("2", "short", "2024-01-02", "X", "a", "train"), ("3", "abcdefghijk", "2024-13-02", "X", "a", "train"), ("4", "abcdefghijk", "2024-01-02", "X", "zz", "train")], "espn_id string, youtube_id string, date string, opponent string, layout string, split string")
    assert [r["fault"] for r in S.checked_registry(games, ["a"]).orderBy("espn_id").collect()] == [None, "bad video id", "bad date", "unknown layout"]
    summary = {
        "game_id": "1", "header": {"competitions": [{"competitors": [{"homeAway": s, "team": {"id": i, "displayName": f"{n} {k}", "name": k, "color": "c"}} for s, i, n, k in (("home", "1", "North", "Hawks"), ("away", "2", "South", "Owls"))]}]},
        "boxscore": {"players": [{"team": {"id": "1"}, "statistics": [{"athletes": [{"athlete": {"jersey": "3", "displayName": "Ann"}, "starter": True}, {"athlete": {"jersey": "", "displayName": "No"}, "starter": False}]}]}]},
        "plays": [{"clock": {"displayValue": "19:30"}, "text": "Ann made Layup. Assisted by Bo.", "team": {"id": "1"}, "type": {"text": "LayUpShot"}, "scoringPlay": True, "scoreValue": 2, "period": {"number": 1}, "awayScore": 0, "homeScore": 2}, {"clock": {"displayValue": "x"}, "text": "", "period": {"number": 2}}],
    }
    (tmp_path / "s.json").write_text(json.dumps(summary))
    tables = S.summary_tables(spark.read.schema("game_id string, " + spec.SUMMARY).json(str(tmp_path / "s.json")))
    assert [(r["team"], r["jersey"], r["name"], r["starter"]) for r in tables["roster"].collect()] == [("North", "3", "Ann", True)]
    play = tables["plays"].collect()
    assert len(play) == 1 and play[0]["text"] == "Ann makes layup (Bo assists)" and play[0]["clock"] == 1170.0 and play[0]["team"] == "North"
    assert tables["periods"].first()["periods"] == [1, 2]
    assert tuple(S.sides_of(tables["teams"]).first()) == ("1", "North", "South")


def two_periods():
    """Two minutes of two periods each; in the second the teams have changed baskets. The holder's cluster attacks: 0 the
    left basket in the first period, 1 in the second."""
    keypoints = [[*seen(x, y), 0.9] for x, y in spec.landmarks()]
    rng, out = np.random.default_rng(7), []
    for start, left_holder in ((0.0, 0), (2400.0, 1)):
        for k in range(120):
            left = k < 60
            holder = left_holder if left else 1 - left_holder
            detections = []
            for j in range(10):
                x, y = (20.0 if left else 74.0) + rng.uniform(-8, 8), 4.0 + 4.2 * j + rng.uniform(-1, 1)
                px, py = seen(x, y)
                holds = j % 2 == holder and j < 2
                detections.append({"track_id": j, "cls": 4 if holds else 3, "conf": 0.9, "bbox": [px - 10, py - 60, px + 10, py], "team_cluster": j % 2})
            t = round(start + k / 10, 3)
            numbers = [{"track_id": 0, "text": "7"}, {"track_id": 1, "text": "5"}] if k % 20 == 0 else []
            out.append({"frame_idx": int(t * 60), "t": t, "keypoints": keypoints, "detections": detections, "ball": None, "numbers": numbers})
    return out


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("halves") / "frames_00.jsonl"
    path.write_text("\n".join(json.dumps(f) for f in two_periods()))
    f = S.read_frames(spark, str(path)).withColumn("game", F.lit("g")).persist()
    rosters = spark.createDataFrame([("g", "Reds", "5", "Ann Lee"), ("g", "Blues", "7", "Bo Ray")], "game string, team string, jersey string, name string")
    return f, rosters


def test_teams_that_change_baskets(spark, halves):
    """With the periods' spans each half has its own map; clusters are named by the numbers read: 5 is worn in cluster 1."""
    f, rosters = halves
    spans = spark.createDataFrame([("g", 1, 0.0, 1200.0), ("g", 2, 2400.0, 3600.0)], "game string, period int, t_lo double, t_hi double")
    names = spark.createDataFrame([("g", "Reds", "Blues")], "game string, home string, away string")
    built = P.build_possessions(f, rosters, names, spans=spans)
    found = [(r["attacking_basket"], r["offense_team"]) for r in built["possessions"].orderBy("start_time").collect()]
    assert found == [("left", "Blues"), ("right", "Reds"), ("left", "Reds"), ("right", "Blues")]
    assert {(r["name"], r["team"]) for r in built["points"].filter("name is not null").collect()} == {("Ann Lee", "Reds"), ("Bo Ray", "Blues")}
    elsewhere = spark.createDataFrame([("g", 1, 0.0, 1200.0)], "game string, period int, t_lo double, t_hi double")
    late = P.build_possessions(f, rosters, names, spans=elsewhere)["possessions"].orderBy("start_time").collect()
    assert [r["offense_team"] for r in late] == ["Blues", "Reds", None, None]  # between the periods nothing is guessed


def test_clusters_are_named_by_numbers_then_brightness(spark, halves):
    f, rosters = halves
    on_court = P.detections_on_court(P.projected(f))
    names = spark.createDataFrame([("g", "Reds", "Blues")], "game string, home string, away string")
    light = spark.createDataFrame([("g", 0, 200.0), ("g", 1, 90.0)], "game string, cluster int, brightness double")
    numbers = P.track_numbers(f, rosters, names)
    named = lambda n, b: tuple(P.home_clusters(on_court, n, names, b).select("home_cluster", "how").first())
    assert named(numbers, light) == (1, "numbers")
    assert named(numbers.limit(0), light) == (0, "brightness") and named(numbers.limit(0), None) == (0, "brightness")
    dark = light.withColumn("brightness", 300.0 - F.col("brightness"))
    assert named(numbers.limit(0), dark) == (1, "brightness")


# --- set-ups and their thresholds --------------------------------------------------------------------------------


def setup_case(spark):
    """Four located intervals at ten frames a second, and one in another period: a dead ball whose team stands still, one
    whose players drift by 1.2 ft, a full-court start, and a live ball that stands later."""
    rows, iv = [], []
    plans = [(0, "dead", False, 0.0, 0.0), (1, "dead", False, 100.0, 1.2), (2, "dead", True, 200.0, 0.0), (3, "live", False, 300.0, 0.0)]
    for interval, kind, full, start, drift in plans:
        iv.append(("g", 1, interval, "Reds", kind, full, True, start, start + 10.0))
        for k in range(-30, 101):
            t = round(start + k / 10, 3)
            for p in range(5):
                moving = k < -5 or (kind == "live" and k < 20) or k > 40
                x = 20.0 + 4 * p + (0.8 * k if moving else 0.0) * (1 if p % 2 else -1) * 0.3 + drift * ((k // 5) % 2)
                rows.append(("g", 1, interval, p, None, True, 50, p == 0, t, min(max(x, 1.0), 46.0), 5.0 + 9 * p))
    i = spark.createDataFrame(iv, "game string, period int, interval int, team string, start_type string, full_court boolean, located boolean, t_start double, t_end double")
    r = spark.createDataFrame(rows, "game string, period int, interval int, track int, name string, detected boolean, length int, holding boolean, t double, x double, y double")
    return i, r


def plain_setup(points, kind, full, start, end, radius, visible, least_still):
    """The rules, frame by frame: points {t: [(x, y)]}, the holder is the first."""
    times = sorted(points)
    moved = lambda t: min((abs(u - (t - 0.5)), u) for u in times if abs(u - (t - 0.5)) <= 0.1 + 1e-9)[1] if t - 0.6 >= times[0] - 1e-9 or t - 0.4 >= times[0] - 1e-9 else None

    def ready(t):
        back = moved(t)
        still = sum(any(np.hypot(x - u, y - v) < radius for u, v in points[back]) for x, y in points[t]) if back is not None else 0
        return len(points[t]) >= visible and still >= least_still and sum(x < 47 for x, _ in points[t]) >= visible

    t0 = min(t for t in times if start - 1 <= t <= end and points[t][0][0] < 47)
    t0 = max(t0, start) if kind == "live" else t0
    dead = [t for t in times if kind == "dead" and not full and start - 3 <= t <= start + 1.5 and ready(t)]
    if dead:
        return dead[-1]
    far = lambda t: np.hypot(points[t][0][0] - 5.25, points[t][0][1] - 25) > 22.146
    return next((t for t in times if t0 <= t <= min(t0 + 6, end) and ready(t) and far(t)), None)


def test_sensitivity_is_the_finder_run_for_each_pair(spark):
    iv, rows = setup_case(spark)
    radii, players = [0.3, 1.0, 1.5, 2.0], [3, 4, 6]
    points, meta = {}, {r["interval"]: r for r in iv.collect()}
    for r in rows.orderBy("interval", "t", "track").collect():
        points.setdefault(r["interval"], {}).setdefault(r["t"], []).append((r["x"], r["y"]))
    want = {(f, n): sum(plain_setup(points[i], m["start_type"], m["full_court"], m["t_start"], m["t_end"], f, n, n) is not None for i, m in meta.items()) for f in radii for n in players}
    got = {(r["radius"], r["players"]): (r["setups"], r["records"]) for r in H.setup_sensitivity(iv, rows, radii=radii, players=players).collect()}
    assert got == {k: (v, 4) for k, v in want.items()} and len(set(want.values())) > 2
    only = H.setup_sensitivity(iv, rows, radii=[1.5], players=[3], start_types=["live"]).first()
    assert (only["records"], only["setups"], only["share"]) == (1, 1, 1.0)
    assert H.setup_sensitivity(iv.limit(0), rows.limit(0), radii=[1.5], players=[3]).first()["share"] is None


def test_setups_are_where_the_rules_have_them(spark):
    iv, rows = setup_case(spark)
    points = {}
    for r in rows.orderBy("interval", "t", "track").collect():
        points.setdefault(r["interval"], {}).setdefault(r["t"], []).append((r["x"], r["y"]))
    found = {r["interval"]: r for r in H.setups(iv, rows).collect()}
    for i, r in found.items():
        want = plain_setup(points[i], r["start_type"], r["full_court"], r["t_start"], r["t_end"], 1.5, 4, 3)
        assert want is not None and not r["no_setup"] and r["setup"] == want
        assert r["n_visible_at_setup"] == 5 and not r["suspect_duplicates"] and not r["transition"]
    assert found[0]["setup"] == 1.5  # the last still frame of the window


def test_a_team_without_a_direction_is_not_located(spark):
    """Its points are left out; x is never taken as it is."""
    iv, rows = setup_case(spark)
    possessions = spark.createDataFrame([("g", 1, 0.0, 400.0)], "game string, possession int, start_time double, end_time double")
    points = rows.withColumn("possession", F.lit(1)).withColumn("team", F.lit("Reds")).withColumn("jersey", F.lit("1")).drop("period", "interval").dropDuplicates(["t", "track"])
    known = spark.createDataFrame([("g", 1, "Reds", "right")], "game string, period int, team string, basket string")
    turned = H.gathered(iv, possessions, points, known)
    assert turned.count() > 0 and turned.agg(F.min("x")).first()[0] > 47
    assert H.gathered(iv, possessions, points, known.filter("team = 'Blues'")).count() == 0
