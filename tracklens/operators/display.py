"""What reports, overlays and pages look up: readings in order, shared times, active events, resampled tracks, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import nearest_within


def readings_in_order(reads: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, readings): the non-null values of each track, in order."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(order, value))))
    return reads.groupBy(*keys).agg(F.transform(pairs, lambda p: p[value]).alias("readings"))


def mean_brightness(crops: DataFrame, keys: list[str], value: str) -> DataFrame:
    return crops.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("brightness"))


def common_times(a: DataFrame, b: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """(keys, t_ms) seen on both sides, to the millisecond."""
    ms = F.round(F.col(t) * 1000).cast("long").alias("t_ms")
    return a.select(*keys, ms).intersect(b.select(*keys, ms))


def roster_names(players: DataFrame, name: str = "name") -> DataFrame:
    return players.agg(F.array_sort(F.collect_set(name)).alias("names"))


def on_one_roster(home: Column, away: Column) -> Column:
    """0 for the home roster, 1 for the other, null for both or neither."""
    return F.when(home & ~away, 0).when(away & ~home, 1)


def active_events(events: DataFrame, times: DataFrame, *, keys: list[str], hold: float = 3.0) -> DataFrame:
    """(keys, t, events): those shown at t, the latest first: passed, but by less than `hold` seconds.

    An event is looked up in the seconds in which it can be shown.
    """
    e = events.filter("t is not null").select(*keys, "event_id", F.col("t").alias("_e"), F.explode(F.sequence(F.floor("t").cast("long") - 1, F.floor(F.col("t") + hold).cast("long"))).alias("_s"))
    hits = times.withColumn("_s", F.floor("t").cast("long")).join(e, [*keys, "_s"]).filter((F.col("_e") <= F.col("t") + 1e-6) & (F.col("t") + 1e-6 < F.col("_e") + hold))
    shown = hits.groupBy(*keys, "t").agg(F.sort_array(F.collect_list(F.struct("_e", "event_id")), asc=False).alias("_l"))
    return shown.select(*keys, "t", F.transform("_l", lambda x: x["event_id"]).alias("events"))


def resampled(points: DataFrame, *, keys: list[str], step: float, tolerance: float) -> DataFrame:
    """(keys, t, x, y): each track on an even grid of times, the nearest frame within tolerance, one decimal."""
    k = F.sequence(F.ceil(F.min("t") / step).cast("long"), F.floor(F.max("t") / step).cast("long"))
    grid = points.groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"), F.when(F.ceil(F.min("t") / step) <= F.floor(F.max("t") / step), k).alias("_k")).select(*keys, F.explode("_k").alias("_g")).withColumn("t", F.col("_g") * step)
    rows = points.select(*keys, F.col("t").alias("_rt0"), F.struct(F.round("x", 1).alias("x"), F.round("y", 1).alias("y")).alias("_xy"))
    found = nearest_within(grid, rows, keys=keys, left_t="t", right_t="_rt0", value="_xy", tolerance=tolerance, left_id=[*keys, "_g"], out="_p")
    return found.filter("_p is not null").select(*keys, "t", "_p.x", "_p.y")


def labelled_positions(merged: Column, tracks: Column) -> Column:
    """Merged positions with the label of the nearest track under a foot: its jersey, else its id modulo 1000."""

    def label(p):
        near = F.array_min(F.transform(F.filter(tracks, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]) < 1.0), lambda q: F.struct(F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("d"), F.coalesce(q["jersey"], (q["track"] % 1000).cast("string")).alias("label"))))
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), near["label"].alias("label"))

    return F.transform(merged, label)


def opponent_names(games: DataFrame, teams: DataFrame, team: str) -> DataFrame:
    """(game_id, opponent) for every game (game_id, opponent of the registry or null): the short name of the side of the
    summary (teams: game_id, side, team) that is not `team`, where both sides are there; else the registry's; else the id."""
    sides = teams.groupBy("game_id").agg(F.max(F.when(F.col("side") == "home", F.col("team"))).alias("_home"), F.max(F.when(F.col("side") == "away", F.col("team"))).alias("_away"))
    seen = F.when(F.col("_home").isNotNull() & F.col("_away").isNotNull(), F.when(F.col("_home") == team, F.col("_away")).otherwise(F.col("_home")))
    return games.join(sides, "game_id", "left").select("game_id", F.coalesce(seen, "opponent", "game_id").alias("opponent"))


def position_at(points: DataFrame, moments: DataFrame, *, keys: list[str], tolerance: float = 0.051) -> DataFrame:
    """moments (keys, t and more) plus x and y: the position of the point (keys, t, x, y) nearest in time, null if none is
    within tolerance."""
    seen = points.select(*keys, F.col("t").alias("_pt"), F.struct("x", "y").alias("_xy"))
    found = nearest_within(moments, seen, keys=keys, left_t="t", right_t="_pt", value="_xy", tolerance=tolerance, left_id=[*keys, "t"], out="_at")
    return found.select(*moments.columns, F.col("_at.x").alias("x"), F.col("_at.y").alias("y"))


def players_of_events(events: DataFrame, points: DataFrame, *, tolerance: float = 0.051) -> DataFrame:
    """events (game, possession, player, t and more) plus track, x and y: where the named player was then, by equality of
    names; the lowest track on ties, nulls where none is seen."""
    named = points.filter(F.col("name").isNotNull()).select("game", "possession", F.col("name").alias("player"), F.col("t").alias("_pt"), F.struct("track", "x", "y").alias("_at"))
    first = named.groupBy("game", "possession", "player", "_pt").agg(F.min("_at").alias("_at"))
    own = ["game", "possession", "player", "t"]
    found = nearest_within(events, first, keys=own[:3], left_t="t", right_t="_pt", value="_at", tolerance=tolerance, left_id=own, out="_seen")
    return found.select(*events.columns, F.col("_seen.track").alias("track"), F.col("_seen.x").alias("x"), F.col("_seen.y").alias("y"))


def boxes_by_time(points: DataFrame) -> DataFrame:
    """(game, possession, t, boxes): for each frame the boxes of its tracks, by track."""
    return points.filter(F.col("bbox").isNotNull()).groupBy("game", "possession", "t").agg(F.sort_array(F.collect_list(F.struct("track", "bbox"))).alias("boxes"))


def tiles_in_order(records: DataFrame, *, n: int = 0) -> DataFrame:
    """records with `tile`, from 1, in the order in which they are shown: by start type (ato, dead, live), then from the
    first to the last of a period (the clock runs down); the first n (0: all)."""
    kind = F.array_position(F.array(F.lit("ato"), F.lit("dead"), F.lit("live")), F.col("start_type"))
    place = F.row_number().over(Window.partitionBy("game").orderBy(F.when(kind > 0, kind).otherwise(9), F.desc("start_clock"), "key"))
    rows = records.withColumn("tile", place)
    return rows.filter(F.col("tile") <= n) if n else rows


def roster_order(players: DataFrame, *, team: str, jersey: str, name: str) -> DataFrame:
    """players with their rank in their team: by the number of the jersey, those without a number last, then by name."""
    number = F.regexp_replace(F.col(jersey).cast("string"), r"\D", "").try_cast("int")
    return players.withColumn("rank", F.row_number().over(Window.partitionBy(team).orderBy(number.asc_nulls_last(), name)))


def spans_json(spans: DataFrame) -> DataFrame:
    """(game, spans): the period spans of each game as JSON."""
    return spans.groupBy("game").agg(F.to_json(F.sort_array(F.collect_list(F.struct("period", "t_lo", "t_hi")))).alias("spans"))


def team_flags(rosters: DataFrame) -> DataFrame:
    """(team, flag): team:number,number... with numbers before texts, in order."""
    key = lambda j: F.struct(F.coalesce(j.try_cast("int"), F.lit(1 << 30)).alias("n"), j.alias("j"))
    numbers = F.transform(F.array_sort(F.collect_set(key(F.col("jersey")))), lambda s: s["j"])
    return rosters.groupBy("team").agg(numbers.alias("_j")).select("team", F.concat("team", F.lit(":"), F.array_join("_j", ",")).alias("flag"))
