"""From frames to possessions, and from possessions to annotated ones: the pipeline over one or many games.

frames: game plus the fields of the frame schema. rosters: game, team, jersey, name. All intermediate tables are long
and keyed by game, so games run side by side; state machines see one game or possession at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import court as C
from ..functions import text as X
from ..plans import spec
from ..plans.session import checkpointed
from .joins import assign_to_windows, located_events, mentioned_player, nearest_within, overlapping
from .scoreboard import clean_timeline
from .states import debounced
from .tracks import clean_paths, homography, resolve_conflicts, stitch_tracks
from .votes import capped_team, first_seen_majority, offense_maps_by_span, outcome, plurality, segment_offense, team_by_jersey, team_of_cluster
from .windows import segments

MARGIN, LEAST_PLAYERS, FLIP_S, LEAST_TRACK_S, VOTE_S = 3.0, 6, 1.5, 1.5, 20


def projected(frames: DataFrame, *, confidence: float = 0.5, worst: float = 2.0) -> DataFrame:
    """frames plus fit, t_ms and the ball on the court (bx, by)."""
    f = frames.withColumn("fit", homography(F.col("keypoints"), confidence=confidence, worst=worst)).withColumn("t_ms", F.round(F.col("t") * 1000).cast("long"))
    bx, by = C.project(F.col("fit.h"), *C.box_center(F.col("ball")))
    return f.withColumn("bx", bx).withColumn("by", by)


def detections_on_court(proj: DataFrame) -> DataFrame:
    """(game, t, t_ms, track, cls, cluster, bbox, x, y): players whose feet are on the court or near it."""
    d = proj.filter("fit is not null").select("game", "t", "t_ms", "fit.h", F.explode("detections").alias("_d")).filter(F.col("_d.cls").isin(*spec.PLAYER_CLASSES))
    x, y = C.project(F.col("h"), *C.bottom_center(F.col("_d.bbox")))
    rows = d.select("game", "t", "t_ms", F.col("_d.track_id").cast("long").alias("track"), F.col("_d.cls").alias("cls"), F.col("_d.team_cluster").alias("cluster"), F.col("_d.bbox").alias("bbox"), x.alias("x"), y.alias("y"))
    return rows.filter(C.inside_court(F.col("x"), F.col("y"), MARGIN))


def frame_states(on_court: DataFrame) -> DataFrame:
    """(game, t, half) of the valid frames: a fit and enough players on the court."""
    s = on_court.groupBy("game", "t").agg(F.count("*").alias("_n"), F.median("x").alias("_x")).filter(F.col("_n") >= LEAST_PLAYERS)
    return s.select("game", "t", C.action_half(F.col("_x")).alias("half"))


def possession_segments(states: DataFrame, *, fps: float) -> DataFrame:
    settled = debounced(states, key="game", order=["t"], label="half", least=int(round(FLIP_S * fps)))
    return segments(settled, key="game", t="t", label="half", max_gap=3.0, merge_gap=12.0, min_duration=3.0, frame=1.0 / fps)


def track_numbers(frames: DataFrame, rosters: DataFrame, names: DataFrame) -> DataFrame:
    """(game, member, home_votes, away_votes, home_jersey, away_jersey): plurality of readings on either roster."""
    reads = frames.select("game", F.explode("numbers").alias("_n")).select("game", F.col("_n.track_id").cast("long").alias("member"), X.jersey_number(F.col("_n.text")).alias("jersey")).filter("jersey is not null")
    r = reads.join(rosters.select("game", "team", "jersey"), ["game", "jersey"]).join(names, "game")
    sides = []
    for side in ("home", "away"):
        v = plurality(r.filter(F.col("team") == F.col(side)), ["game", "member"], "jersey")
        sides.append(v.select("game", "member", F.col("votes").alias(f"{side}_votes"), F.col("winner").alias(f"{side}_jersey")))
    return sides[0].join(sides[1], ["game", "member"], "full")


def home_clusters(on_court: DataFrame, numbers: DataFrame, names: DataFrame, brightness: DataFrame | None) -> DataFrame:
    """(game, home_cluster, how): which cluster plays at home, from the numbers read on each cluster's tracks, else from
    brightness (game, cluster, brightness)."""
    clusters = first_seen_majority(on_court, ["game", "track"], "cluster", "t_ms").select("game", F.col("track").alias("member"), "cluster")
    counted = numbers.join(clusters, ["game", "member"]).groupBy("game", "cluster").agg(F.sum(F.coalesce("home_votes", F.lit(0))).alias("home_votes"), F.sum(F.coalesce("away_votes", F.lit(0))).alias("away_votes"))
    both = names.select("game", F.explode(F.array(F.lit(0), F.lit(1))).alias("cluster")).join(counted, ["game", "cluster"], "left").fillna(0, ["home_votes", "away_votes"])
    light = brightness.select("game", "cluster", "brightness") if brightness is not None else both.select("game", "cluster", F.lit(0.0).alias("brightness"))
    return team_of_cluster(both.join(light, ["game", "cluster"], "left").fillna(0.0, ["brightness"]))


def offense_by_period(segs: DataFrame, votes: DataFrame, spans: DataFrame) -> DataFrame:
    """(game, possession, offense): the cluster that the map of the segment's period, by its middle, has attack its half;
    no row for segments between periods. A period without votes has the map of a tie."""
    numbered = spans.select("game", F.col("period").alias("span"), "t_lo", "t_hi")
    maps = offense_maps_by_span(votes, numbered, keys=["game"])
    middle = segs.withColumn("_t", (F.col("t_lo") + F.col("t_hi")) / 2).select("game", "possession", "half", "_t", F.col("_t").alias("_t2"))
    inside = overlapping(numbered, middle, keys=["game"], left_range=("t_lo", "t_hi"), right_range=("_t", "_t2"), width=600.0).filter(F.col("_t") < F.col("t_hi"))
    found = inside.join(maps.select("game", "span", "right_team"), ["game", "span"])
    attacks = F.when(F.col("half") == 1, F.col("right_team")).otherwise(1 - F.col("right_team"))
    return found.groupBy("game", "possession").agg(F.min_by(attacks, "span").alias("offense"))


def build_possessions(frames: DataFrame, rosters: DataFrame, names: DataFrame, *, fps: float = 10.0, spans: DataFrame | None = None, brightness: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables `possessions` and `points`.

    names: (game, home, away) and, if it is known, home_cluster, the cluster that plays at home; without that column (or
    where it is null) it is found from the numbers read, else from brightness (game, cluster, brightness). spans: (game,
    period, t_lo, t_hi) of the scoreboard; teams change baskets between periods, so each has an offence map of its own.
    A game without spans has votes and time windows decide. points: a row a track and frame with the team, jersey and
    name that the track got; tracks shorter than 1.5 s are left out.
    """
    proj = checkpointed(projected(frames))  # the fits are read by five branches; so are the tables below
    on_court = checkpointed(detections_on_court(proj))
    states = checkpointed(frame_states(on_court))
    numbers = checkpointed(track_numbers(proj, rosters, names))
    found = home_clusters(on_court, numbers, names, brightness).select("game", F.col("home_cluster").alias("_found"))
    given = F.col("home_cluster") if "home_cluster" in names.columns else F.lit(None).cast("int")
    names = checkpointed(names.join(found, "game", "left").select("game", "home", "away", F.coalesce(given, "_found").alias("home_cluster")))
    segs = possession_segments(states, fps=fps).withColumnRenamed("segment", "possession")
    segs = checkpointed(segs)
    grid = overlapping(states.withColumn("_t2", F.col("t")), segs.select("game", "possession", "t_lo", "t_hi"), keys=["game"], left_range=("t", "_t2"), right_range=("t_lo", "t_hi"), width=60.0)
    grid = grid.withColumn("frame", F.row_number().over(Window.partitionBy("game", "possession").orderBy("t")).cast("long")).select("game", "possession", "t", "frame")
    grid = checkpointed(grid)

    d = on_court.join(grid, ["game", "t"])
    clusters = first_seen_majority(on_court, ["game", "track"], "cluster", "t_ms").select("game", "track", F.col("cluster").alias("_c"))
    d = d.join(clusters, ["game", "track"], "left").withColumn("cluster", F.col("_c")).drop("_c").withColumnRenamed("track", "member").dropDuplicates(["game", "possession", "member", "frame"])
    d = checkpointed(d)
    members = checkpointed(stitch_tracks(d.withColumn("track", F.col("member")), keys=["game", "possession"], fps=fps))
    d = d.join(members, ["game", "possession", "member"])
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("game", "possession", "track", "frame").orderBy("ord"))).filter("_n = 1").drop("_n")
    d = checkpointed(d)
    tracks = d.groupBy("game", "possession", "track").agg(F.count("*").alias("length"), F.first("cluster", True).alias("cluster"), F.min("t").alias("t_lo"), F.max("t").alias("t_hi")).filter(F.col("length") >= max(2, int(LEAST_TRACK_S * fps)))

    whole = tracks.select("game", "possession", "track").join(grid, ["game", "possession"]).join(d.select("game", "possession", "track", "frame", "x", "y", "bbox"), ["game", "possession", "track", "frame"], "left")
    whole = checkpointed(whole)
    paths = clean_paths(whole, keys=["game", "possession", "track"])
    seen = whole.filter("x is not null").select("game", "possession", "track", "frame", "t", "bbox").join(paths, ["game", "possession", "track", "frame"])
    seen = checkpointed(seen)

    votes = numbers.join(members, ["game", "member"]).groupBy("game", "possession", "track").agg(*[F.sum(F.coalesce(f"{s}_votes", F.lit(0))).alias(f"{s}_votes") for s in ("home", "away")], *[F.max_by(f"{s}_jersey", f"{s}_votes").alias(f"{s}_jersey") for s in ("home", "away")])
    t = tracks.join(votes, ["game", "possession", "track"], "left").join(names, "game").fillna(0, ["home_votes", "away_votes"])
    by_cluster = F.when(F.col("cluster").isNull(), None).when(F.col("cluster") == F.col("home_cluster"), F.col("home")).otherwise(F.col("away"))
    t = t.withColumn("team", team_by_jersey(by_cluster, F.col("home"), F.col("away"), F.col("home_votes"), F.col("away_votes")))
    at_home = F.col("team") == F.col("home")
    t = t.withColumn("jersey", F.when(at_home, F.col("home_jersey")).when(F.col("team") == F.col("away"), F.col("away_jersey"))).withColumn("votes", F.when(at_home, F.col("home_votes")).otherwise(F.col("away_votes")))
    t = t.join(resolve_conflicts(t, keys=["game", "possession"]), ["game", "possession", "track"]).withColumn("jersey", F.when(F.col("keeps"), F.col("jersey")))
    t = checkpointed(t.join(rosters.select("game", "team", "jersey", "name"), ["game", "team", "jersey"], "left"))
    rows = seen.join(t.select("game", "possession", "track", "team", "name", "length"), ["game", "possession", "track"]).withColumn("named", F.col("name").isNotNull())
    capped = capped_team(rows, keys=["game", "possession"]).filter("demoted").select("game", "possession", "track", "demoted")
    t = t.join(capped, ["game", "possession", "track"], "left").withColumn("team", F.when(F.col("demoted").isNull(), F.col("team")))

    holders = on_court.filter(F.col("cls") == spec.HOLDING_CLASS)
    corner = lambda c: F.transform(c, lambda v: F.round(v, 1))
    held = holders.select("game", F.round("t", 3).alias("_t"), corner(F.col("bbox")).alias("_b")).distinct().withColumn("holding", F.lit(True))
    points = seen.join(t.select("game", "possession", "track", "team", "jersey", "name", "length"), ["game", "possession", "track"]).withColumn("_t", F.round("t", 3)).withColumn("_b", corner(F.col("bbox"))).join(held, ["game", "_t", "_b"], "left")
    points = points.select("game", "possession", "track", "team", "jersey", "name", "t", "x", "y", "bbox", F.lit(True).alias("detected"), F.coalesce("holding", F.lit(False)).alias("holding"), "length")

    offense_votes = holders.filter("cluster is not null").join(states, ["game", "t"]).select("game", "t", "half", "cluster")
    offense = segment_offense(segs.select("game", F.col("possession").alias("segment"), "half", "t_lo", "t_hi"), offense_votes, keys=["game"], min_votes=round(VOTE_S * fps))
    offense = offense.select("game", F.col("segment").alias("possession"), "offense")
    if spans is not None:
        mapped = offense_by_period(segs, offense_votes, spans).withColumnRenamed("offense", "_mapped")
        with_spans = spans.select("game").distinct().withColumn("_has", F.lit(True))
        offense = offense.join(mapped, ["game", "possession"], "left").join(with_spans, "game", "left")
        offense = offense.select("game", "possession", F.when(F.col("_has"), F.col("_mapped")).otherwise(F.col("offense")).alias("offense"))
    p = segs.join(offense, ["game", "possession"]).join(names, "game")
    team = F.when(F.col("offense") == F.col("home_cluster"), F.col("home")).when(F.col("offense").isNotNull(), F.col("away"))
    ball = proj.filter("bx is not null").select("game", "t", "bx", "by").join(grid, ["game", "t"]).groupBy("game", "possession").agg(F.sort_array(F.collect_list(F.array("t", F.round("bx", 2), F.round("by", 2)))).alias("ball"))
    p = p.join(ball, ["game", "possession"], "left")
    possessions = p.select("game", "possession", F.col("t_lo").alias("start_time"), F.col("t_hi").alias("end_time"), F.lit(fps).alias("fps"), team.alias("offense_team"), F.when(F.col("half") == 1, "right").otherwise("left").alias("attacking_basket"), "ball")
    return {"possessions": possessions, "points": points}


def nested(possessions: DataFrame, points: DataFrame) -> DataFrame:
    """The possession records of the JSON sink: tracks with trajectories, boxes and holding times."""
    order = lambda c: F.sort_array(F.collect_list(c))
    tracks = points.groupBy("game", "possession", "track").agg(
        F.first("team").alias("team"), F.first("jersey").alias("jersey"), F.first("name").alias("name"), order(F.array("t", F.round("x", 2), F.round("y", 2))).alias("trajectory"),
        order(F.concat(F.array("t"), F.col("bbox"))).alias("boxes"), F.sort_array(F.collect_set(F.when(F.col("holding"), F.col("t")))).alias("holding"),
    )
    players = tracks.groupBy("game", "possession").agg(F.sort_array(F.collect_list(F.struct(F.col("track").cast("int").alias("track_id"), "team", "jersey", "name", "trajectory", "boxes", "holding"))).alias("players"))
    return possessions.join(players, ["game", "possession"], "left").withColumnRenamed("possession", "possession_id")


def annotated(possessions: DataFrame, reads: DataFrame, spans: DataFrame, plays: DataFrame, rosters: DataFrame, *, reach: float = 15.0) -> dict[str, DataFrame]:
    """Tables `possessions` (plus clocks, scores, points and outcome) and `events` (play, possession, video time, player).

    Reads are cleaned by period against the score states of the plays. A possession on a boundary belongs to the later
    period. Scores after are those three seconds past the end.
    """
    w = Window.partitionBy("game", "period").orderBy("seq")
    state = F.struct(F.col("away_score").alias("away"), F.col("home_score").alias("home"))
    changed = plays.withColumn("_s", state).withColumn("_p", F.lag("_s").over(w)).filter(~F.col("_p").eqNullSafe(F.col("_s")))
    zero = F.struct(F.lit(0).alias("away"), F.lit(0).alias("home"))
    states = changed.groupBy("game", "period").agg(F.concat(F.array(zero), F.transform(F.sort_array(F.collect_list(F.struct("seq", "_s"))), lambda x: x["_s"])).alias("states"))
    inside = overlapping(reads.withColumn("_t2", F.col("t")), spans, keys=["game"], left_range=("t", "_t2"), right_range=("t_lo", "t_hi"), width=600.0).select("game", "period", "t", "clock", "clock_text", "away", "home")
    clean = checkpointed(clean_timeline(inside, keys=["game", "period"], states=states))  # read for six values
    p = overlapping(possessions, spans, keys=["game"], left_range=("start_time", "end_time"), right_range=("t_lo", "t_hi"), width=600.0).withColumn("_n", F.row_number().over(Window.partitionBy("game", "possession").orderBy(F.desc("period")))).filter("_n = 1").drop("_n", "t_lo", "t_hi")
    own = ["game", "period", "possession"]
    p = checkpointed(p)  # read by three look-ups
    moment = lambda name, t: F.struct(F.lit(name).alias("which"), t.alias("at"))
    moments = p.select(*own, F.inline(F.array(moment("start", F.col("start_time")), moment("end", F.col("end_time")), moment("after", F.col("end_time") + 3.0))))
    for value, wanted in (("clock", {"clock_start": "start", "clock_end": "end"}), ("away", {"away_before": "start", "away_after": "after"}), ("home", {"home_before": "start", "home_after": "after"})):
        shown = clean.select("game", "period", F.col("t").alias("_rt0"), F.col(value).alias("_v0"))
        found = nearest_within(moments, shown, keys=["game", "period"], left_t="at", right_t="_rt0", value="_v0", tolerance=reach if value == "clock" else 6.0, left_id=[*own, "which"], out="_v")
        p = p.join(found.groupBy(*own).agg(*[F.max(F.when(F.col("which") == which, F.col("_v"))).alias(name) for name, which in wanted.items()]), own, "left")
    p = checkpointed(p)
    windows = p.select("game", "period", F.col("possession").alias("window_id"), F.least("clock_start", "clock_end").alias("lo"), F.greatest("clock_start", "clock_end").alias("hi"), F.col("clock_start").alias("start"), F.col("offense_team").alias("team")).filter("lo is not null and hi is not null")
    e = plays.withColumn("event_id", F.col("seq")).withColumn("offensive", F.col("team").isNotNull() & X.is_offensive(F.col("type"), F.col("text"))).withColumn("dead", X.is_dead_ball(F.col("type"), F.col("text")))
    picked = assign_to_windows(windows, e.select("game", "period", "event_id", "clock", "team", "offensive", "dead"), keys=["game", "period"])
    events = e.join(picked, ["game", "period", "event_id"]).withColumnRenamed("window_id", "possession").join(p.select("game", "period", "possession", F.col("start_time").alias("start_t"), F.col("end_time").alias("end_t"), "clock_start", "clock_end", F.col("offense_team").alias("offense")), ["game", "period", "possession"])
    events = located_events(events, clean.select("game", "period", "t", "clock"), keys=["game", "period"])
    unique = events.withColumn("event_id", F.concat_ws(":", "game", "period", "seq"))
    ord_ = F.row_number().over(Window.partitionBy("game").orderBy(*(["ord"] if "ord" in rosters.columns else []), "team", "name"))
    events = mentioned_player(unique, rosters.dropDuplicates(["game", "team", "name"]).select("game", "team", "name", ord_.alias("ord")), keys=["game"])
    results = outcome(events, ["game", "period", "possession"])
    p = p.join(results.withColumnRenamed("points", "points_scored"), own, "left")
    return {"possessions": p, "events": events}
