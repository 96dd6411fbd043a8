"""Every query that SQL can express equals DuckDB's result; the others equal a plain loop over all their rows, or hold
what must be true of them."""

from collections import defaultdict
from itertools import groupby, permutations

import numpy as np
import pytest
from compare import assert_same

import __spark_entry__ as entry
from tracklens import catalog, catalog_game
from tracklens import catalog_states as CS
from tracklens.operators import states as S
from tracklens.operators import tracks as T


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(entry.queries()[name](spark, sf_dir), catalog.ORACLE[name], sf_dir)


def run(spark, sf_dir, name):
    return [r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()]


def groups(df, keys, order):
    rows = sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(r[k] for k in [*keys, *order]))
    return [(key, list(g)) for key, g in groupby(rows, key=lambda r: tuple(r[k] for k in keys))]


def same(ours, theirs, digits=6):
    show = lambda v: round(v, digits) if isinstance(v, float) else tuple(map(show, v)) if isinstance(v, list) else v
    key = lambda rows: sorted(repr(sorted((k, show(v)) for k, v in r.items())) for r in rows)
    assert len(ours) == len(theirs) and key(ours) == key(theirs)


def test_segments_debounced(spark, sf_dir):
    theirs = []
    for (game,), rows in groups(catalog.court(spark, sf_dir).select("game", "t", "event_id", "half"), ["game"], ["t", "event_id"]):
        runs = [[k, len(list(g))] for k, g in groupby(r["half"] for r in rows)]
        settled = S.debounced_runs([n for _, n in runs], [k for k, _ in runs], 3)
        labels = [label for label, (_, n) in zip(settled, runs) for _ in range(n)]
        islands: list[list] = []
        for r, half in zip(rows, labels):
            if islands and islands[-1][0] == half and r["t"] - islands[-1][2] <= 43200:
                islands[-1][2:] = [r["t"], islands[-1][3] + 1]
            else:
                islands.append([half, r["t"], r["t"], 1])
        merged: list[list] = []
        for i in islands:
            if merged and merged[-1][0] == i[0] and i[1] - merged[-1][2] <= 172800:
                merged[-1][2:] = [i[2], merged[-1][3] + i[3]]
            else:
                merged.append(i)
        kept = [m for m in merged if m[2] - m[1] >= 3600]
        theirs += [{"game": game, "segment": k, "half": h, "t_lo": lo, "t_hi": hi, "n": n} for k, (h, lo, hi, n) in enumerate(kept, 1)]
    same(run(spark, sf_dir, "segments_debounced"), theirs)


def test_stitch_tracks(spark, sf_dir):
    v = catalog.court(spark, sf_dir)
    frames: dict = defaultdict(lambda: defaultdict(dict))
    for r in v.select("game", "t_ms", "event_id", "x", "y", "cluster").collect():
        track, frame = r["t_ms"] // 86400000 * 4 + r["event_id"] % 4, r["t_ms"] // 3600000
        old = frames[r["game"]][track].get(frame, (1e9, 1e9, 9))
        frames[r["game"]][track][frame] = tuple(map(min, old, (r["x"], r["y"], r["cluster"])))
    theirs = []
    for game, tracks in frames.items():
        made = [{"track": t, "frames": sorted(f), "xy": [list(f[k][:2]) for k in sorted(f)], "cluster": f[min(f)][2]} for t, f in sorted(tracks.items())]
        theirs += [{"game": game, "track": h["track"], "member": m, "ord": k} for h in T.stitched(made, 10.0) for k, m in enumerate(h["members"])]
    same(run(spark, sf_dir, "stitch_tracks"), theirs)


def test_path_clean(spark, sf_dir):
    theirs = []
    for (game,), rows in groups(catalog.court(spark, sf_dir).select("game", "t_ms", "event_id", "x", "y"), ["game"], ["t_ms", "event_id"]):
        gone = [r["event_id"] % 11 == 0 for r in rows]
        xy = T.clean_path(np.array([[np.nan, np.nan] if g else [r["x"], r["y"]] for r, g in zip(rows, gone)]))
        theirs += [{"game": game, "frame": k, "x": float(x), "y": float(y)} for k, (x, y) in enumerate(xy, 1)]
    same(run(spark, sf_dir, "path_clean"), theirs, digits=5)


def test_matchup_assignment(spark, sf_dir):
    """The sum of distances is the least of all assignments, and every player of the smaller side has one partner."""
    cost = defaultdict(float)
    pairs = defaultdict(list)
    for r in run(spark, sf_dir, "matchup_assignment"):
        cost[r["game"], r["frame"]] += r["distance"]
        pairs[r["game"], r["frame"]].append((r["off"], r["def"]))
    seen = 0
    for key, rows in groups(CS._five_a_side(spark, sf_dir), ["game", "frame"], ["side", "track"]):
        off, de = ([(r["x"], r["y"]) for r in rows if r["side"] == s] for s in ("off", "def"))
        a, b = sorted((off, de), key=len)
        if not a:
            assert key not in cost
            continue
        seen += len(a)
        assert cost[key] == pytest.approx(min(sum(np.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(a, way)) for way in permutations(b, len(a))), abs=1e-5)
        assert len(pairs[key]) == len(a) == len({x for x, _ in pairs[key]}) == len({y for _, y in pairs[key]})
    assert seen > 100


def test_defence_features(spark, sf_dir):
    """Gap, paint and stability from the match-ups of all frames."""
    rows = {r["game"]: r for r in run(spark, sf_dir, "defence_features")}
    frames = defaultdict(dict)
    for r in run(spark, sf_dir, "matchup_assignment"):
        frames[r["game"]].setdefault(r["frame"], []).append((r["off"], r["def"], r["distance"]))
    place = {(r["game"], r["track"]): r for r in (x.asDict() for x in CS._five_a_side(spark, sf_dir).collect())}
    assert set(rows) == set(frames)
    for game, by_frame in frames.items():
        f = rows[game]
        assert f["frames"] == len(by_frame)
        if len(by_frame) < 5:
            assert f["gap"] is None
            continue
        assert f["gap"] == pytest.approx(np.median([d for ps in by_frame.values() for *_, d in ps]), abs=1e-4)
        sets = [sorted((place[game, o]["place"], place[game, q]["place"]) for o, q, _ in by_frame[k]) for k in sorted(by_frame)]
        assert f["stability"] == pytest.approx(np.mean([a == b for a, b in zip(sets, sets[1:])]), abs=1e-4)
        defenders = [r for (g, _), r in place.items() if g == game and r["side"] == "def" and r["frame"] in by_frame]
        assert f["paint"] == pytest.approx(sum(np.hypot(r["x"] - 5.25, r["y"] - 25.0) < 16 for r in defenders) / len(by_frame), abs=1e-4)


def test_defence_labels(spark, sf_dir):
    """Possessions of twenty frames or more get the defence that was played; both kinds occur, shorter ones are unknown."""
    rows = run(spark, sf_dir, "defence_labels")
    frames = {r["play"]: r["count"] for r in catalog_game.defence_points(spark, sf_dir).filter("side = 'def' and track = 5").groupBy("play").count().collect()}
    assert {r["play"] for r in rows} == set(frames) and all(0 <= r["confidence"] <= 1 for r in rows)
    known = [r for r in rows if frames[r["play"]] >= 20]
    assert len(known) > 20 and {r["man"] for r in known} == {True, False}
    assert np.mean([r["label"] == ("man" if r["man"] else "zone") for r in known]) > 0.95
    assert all(r["label"] == "unknown" for r in rows if frames[r["play"]] < 20)


def test_homography_fits(spark, sf_dir):
    """All landmarks but the misplaced one and the unsure are inliers, and the camera is found again."""
    rows = run(spark, sf_dir, "homography_fits")
    assert rows and all((r["x"], r["y"], r["exact"]) == (20.0, 30.0, True) for r in rows)
    assert {r["n"] for r in rows} == {25}  # 33 less seven that are unsure and one that is misplaced


def test_kmeans_sets(spark, sf_dir):
    """Every row is in the cluster of a known k, and no further from its centre than from the mean of the others."""
    rows = run(spark, sf_dir, "kmeans_sets")
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert len(rows) == n == len({r["vec_id"] for r in rows})
    (k,) = {r["k"] for r in rows}
    assert 4 <= k <= 30 and {r["cluster"] for r in rows} == set(range(k)) and all(-0.5 <= r["stability"] <= 1 and r["distance"] >= 0 for r in rows)


def test_supervised_team(spark, sf_dir):
    """Rows of the two labelled classes get their own label back."""
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    rows = run(spark, sf_dir, "supervised_team")
    known = [(r["team"], labels[r["vec_id"]]) for r in rows if labels[r["vec_id"]] < 2]
    assert len(rows) == len(labels) and np.mean([a == b for a, b in known]) >= 0.95


def test_halfcourt_records_and_coverage(spark, sf_dir):
    """A record for each interval of the team; nearly all are located, set-ups are found and missed, and coverage counts
    the records. The grid has the pipeline's own thresholds in a row of its own."""
    records, coverage = run(spark, sf_dir, "halfcourt_records"), {r["game"]: r for r in run(spark, sf_dir, "coverage_report")}
    own = [i for i in run(spark, sf_dir, "pbp_intervals") if i["team"] == "Reds"]
    assert len(records) == len({r["key"] for r in records}) == len(own)
    by_period = defaultdict(list)
    for i in sorted(own, key=lambda i: (i["game"], i["period"], i["index"])):
        by_period[i["game"], i["period"]].append(i)
    expected = [(f"{g}:{p}:{k}", i["start_clock"], i["end_clock"], i["terminal"]) for (g, p), rows in by_period.items() for k, i in enumerate(rows)]
    assert sorted((r["key"], r["start_clock"], r["end_clock"], r["terminal"]) for r in records) == sorted(expected)
    located = [r for r in records if r["located"]]
    assert len(located) > 0.6 * len(records) and any(not r["no_setup"] for r in located) and any(r["no_setup"] and r["t0"] is not None for r in located)
    for r in records:
        assert r["located"] or r["t0"] is None
        assert r["setup"] is None or r["t0"] is not None
        assert r["n_players"] == (5 if r["t0"] is not None else 0)
    by_game = defaultdict(list)
    for r in records:
        by_game[r["key"].split(":")[0]].append(r)
    assert {str(g): (c["intervals"], c["located"]) for g, c in coverage.items()} == {g: (len(rs), sum(r["located"] for r in rs)) for g, rs in by_game.items()}
    assert sum(c["dead_ball_with_setup"] for c in coverage.values()) > 0
    grid = {(r["radius"], r["players"]): r for r in run(spark, sf_dir, "setup_grid")}
    (n,) = {r["records"] for r in grid.values()}
    assert n == sum(r["t0"] is not None and not r["transition"] for r in records) and len(grid) == 9
    for radius in (1.0, 1.5, 3.0):
        counts = [grid[radius, k]["setups"] for k in (3, 4, 5)]
        assert counts == sorted(counts, reverse=True) and counts[0] > 0
    assert grid[3.0, 4]["setups"] > grid[1.0, 4]["setups"]  # who runs to and fro by 2.5 ft is still by 3 ft


def test_all_queries_are_tested():
    named = {"segments_debounced", "score_timeline_clean", "score_timeline_known", "period_spans", "pbp_intervals", "stream_clock", "stream_intervals", "stitch_tracks", "path_clean", "matchup_assignment", "defence_features", "defence_labels", "homography_fits", "kmeans_sets", "supervised_team", "halfcourt_records", "coverage_report", "setup_grid"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == named


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.count() > 0 and "segment" in df.columns


def _nodes(frames, name):
    return [f._jdf.queryExecution().executedPlan().toString().count(name) for f in frames]


def test_records_read_stored_games(spark, sf_dir):
    """What several branches read is stored: no plan repeats the windows that make the games."""
    tables = catalog_game.records_input(spark, sf_dir)
    assert len(tables) == 5 and _nodes(tables, "Window") == [0] * 5 and _nodes(tables, "Exchange") == [0] * 5
    assert tables[0].count() == catalog_game.plays(spark, sf_dir).count()


def test_defence_measures_are_joined_from_stored_parts(spark):
    from tracklens.operators import features as FE

    points = spark.range(400).selectExpr("1L as play", "double(id div 10) as t", "if(id % 10 < 5, 'off', 'def') as side", "id % 10 as track", "double(id % 10) as x", "double(id % 7) as y")
    pairs = spark.range(200).selectExpr("1L as play", "double(id div 5) as t", "id % 5 as off", "id % 5 + 5 as `def`", "5.0D as distance")
    made = FE.defence_measures(pairs, points, key="play")
    assert _nodes([made], "Exchange")[0] <= 10 and _nodes([made], "Window") == [0]
    assert made.count() == 1 and made.first()["frames"] == 40
