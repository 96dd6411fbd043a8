"""Queries of the scoreboard, the play-by-play and the streams, over games that Spark derives from the table events.

A game is the events of ten users. In order of time each event is four seconds of two periods of 1,200 s with a break of
a minute, then of overtime; what follows overtime is left out. It gives two reads of the scoreboard, some of them misread
in one of six ways, and one play of a script whose details (made, stolen, technical) depend on the event.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .functions import text as X
from .operators import clusters as K
from .operators import features as FE
from .operators import halfcourt as H
from .operators import reports as R
from .operators import scoreboard as B
from .operators import states as S
from .operators import tracks as TR
from .operators import windows as W
from .plans.session import checkpointed
from .streaming import events as ST
from .streaming import machines as M

STEP = 4
#: Periods: number, first second, length.
PERIODS = ((1, 0, 1200), (2, 1260, 1200), (3, 2520, 300))
LONG = timedelta(days=60)  # longer than any gap between two events of a game


def game_time(spark, d) -> DataFrame:
    """(game, rank, second, period, clock, h, ts, event_id): every event of a game, with nulls in breaks."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("game", F.floor(F.col("user_id") / 10).cast("int"))
    rank = F.row_number().over(Window.partitionBy("game").orderBy("ts", "event_id")) - 1
    e = e.select("game", "ts", "event_id", rank.alias("rank")).withColumn("second", F.col("rank") * STEP)
    period, clock = F.lit(None).cast("int"), F.lit(None).cast("int")
    for number, start, length in PERIODS:
        inside = (F.col("second") >= start) & (F.col("second") < start + length)
        period, clock = F.when(inside, number).otherwise(period), F.when(inside, start + length - F.col("second")).otherwise(clock)
    return e.filter(F.col("second") < PERIODS[-1][1] + PERIODS[-1][2]).select("game", "ts", "event_id", "rank", "second", period.alias("period"), clock.alias("clock"), (F.col("event_id") % 97).alias("h"))


GAME = """ranked AS (SELECT CAST(user_id // 10 AS INT) AS game, ts, event_id, (row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) - 1) AS rank FROM events),
g AS (SELECT *, rank * 4 AS second, event_id % 97 AS h, CASE WHEN rank * 4 < 1200 THEN 1 WHEN rank * 4 BETWEEN 1260 AND 2459 THEN 2 WHEN rank * 4 BETWEEN 2520 AND 2819 THEN 3 END AS period,
  CASE WHEN rank * 4 < 1200 THEN 1200 - rank * 4 WHEN rank * 4 BETWEEN 1260 AND 2459 THEN 2460 - rank * 4 WHEN rank * 4 BETWEEN 2520 AND 2819 THEN 2820 - rank * 4 END AS clock FROM ranked WHERE rank * 4 < 2820)"""


def _away(rank):
    return (2 * F.floor(rank / 15)).cast("int")


def _home(rank):
    return (3 * F.floor(rank / 22)).cast("int")


def scoreboard(spark, d) -> DataFrame:
    return reads_of(game_time(spark, d))


def reads_of(g: DataFrame) -> DataFrame:
    """(game, ts, t, clock, clock_text, away, home) of game_time's rows: two reads an event, misread where h says so."""
    reads = g.select("*", F.explode(F.array(F.lit(0), F.lit(2))).alias("j"))
    shown = F.col("clock") - F.col("j")
    first, h = F.col("j") == 0, F.col("h")
    digits = F.concat(F.floor(shown / 60).cast("string"), F.lpad((shown % 60).cast("string"), 2, "0"))
    lost = h == 23  # the colon is not read
    clock = F.when(h.isin(17) | lost, F.lit(None)).when((h == 5) & first, shown + 300).when(h == 11, F.col("clock") - 90).otherwise(shown)
    away = F.when(h == 31, F.lit(None)).when((h == 29) & first, 99).otherwise(_away(F.col("rank")))
    home = F.when(h == 31, F.lit(None)).otherwise(_home(F.col("rank")))
    return reads.select("game", "ts", (F.col("second") + F.col("j")).cast("double").alias("t"), clock.cast("double").alias("clock"), F.when(lost & (shown >= 60), digits).alias("clock_text"), away.alias("away"), home.alias("home"))


def score_states(spark, d) -> DataFrame:
    return states_of(game_time(spark, d))


def states_of(g: DataFrame) -> DataFrame:
    """(game, period, states) of game_time's rows: the scores that the game went through in the period, in order."""
    g = g.filter("period is not null").groupBy("game", "period", _away(F.col("rank")).alias("away"), _home(F.col("rank")).alias("home")).agg(F.min("rank").alias("rank"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.struct("away", "home").alias("s"))))
    return g.groupBy("game", "period").agg(F.transform(ordered, lambda x: x["s"]).alias("states"))


def _in_periods(reads: DataFrame) -> DataFrame:
    """Reads with the period that the script has them in; those of breaks are left out."""
    period = F.lit(None).cast("int")
    for number, start, length in PERIODS:
        period = F.when((F.col("t") >= start) & (F.col("t") < start + length), number).otherwise(period)
    return reads.withColumn("period", period).filter("period is not null")


@query()
def period_spans(spark, d):
    return S.period_spans(scoreboard(spark, d), keys=["game"])


@query()
def score_timeline_clean(spark, d):
    """Periods found in the reads, each cleaned on its own with five seconds around it."""
    reads = scoreboard(spark, d).drop("ts")
    return B.clean_periods(reads, period_spans(spark, d))


def known_timeline(g: DataFrame) -> DataFrame:
    return B.clean_timeline(_in_periods(reads_of(g)).drop("ts"), keys=["game", "period"], states=states_of(g))


@query()
def score_timeline_known(spark, d):
    return known_timeline(game_time(spark, d))


@query(
    f"""WITH {GAME}, r AS (SELECT game, period, CAST(second + j AS DOUBLE) AS t, CASE WHEN h = 31 THEN NULL WHEN h = 29 AND j = 0 THEN 99 ELSE 2 * (rank // 15) END AS away, CASE WHEN h = 31 THEN NULL ELSE 3 * (rank // 22) END AS home
  FROM g, (VALUES (0), (2)) AS v(j) WHERE period IS NOT NULL),
s AS (SELECT game, period, away, home, row_number() OVER (PARTITION BY game, period ORDER BY rank) AS place FROM (SELECT game, period, 2 * (rank // 15) AS away, 3 * (rank // 22) AS home, min(rank) AS rank FROM g WHERE period IS NOT NULL GROUP BY ALL)),
f AS (SELECT r.*, place, (lag(t) OVER w IS NOT NULL AND lag(r.away) OVER w IS NOT DISTINCT FROM r.away AND lag(r.home) OVER w IS NOT DISTINCT FROM r.home)
  OR (lead(t) OVER w IS NOT NULL AND lead(r.away) OVER w IS NOT DISTINCT FROM r.away AND lead(r.home) OVER w IS NOT DISTINCT FROM r.home) AS again
  FROM r LEFT JOIN s ON s.game = r.game AND s.period = r.period AND s.away = r.away AND s.home = r.home WINDOW w AS (PARTITION BY r.game, r.period ORDER BY t))
SELECT game, period, t, CAST(away AS INT) AS away, CAST(home AS INT) AS home, coalesce(place = max(CASE WHEN again THEN place END) OVER (PARTITION BY game, period ORDER BY t), FALSE) AS trusted FROM f"""
)
def trusted_scores(spark, d):
    """The scores of the play-by-play alone decide: a running maximum, with no Python."""
    return B.trusted_scores(_in_periods(scoreboard(spark, d)), keys=["game", "period"], states=score_states(spark, d))


# --- plays ----------------------------------------------------------------------------------------------------------

#: The script: what happens at each place of eleven plays, whether the team with the ball does it, and how many plays
#: before have the same clock.
SCRIPT = (("miss", True, 0), ("rebound", None, 0), ("make", True, 0), ("turnover", False, 0), ("steal", True, 1), ("foul", False, 0), ("throw 1", True, 1), ("throw 2", True, 2), ("pause", True, 0), ("other", True, 0), ("shot", True, 0))


def plays(spark, d) -> DataFrame:
    return plays_of(game_time(spark, d))


def plays_of(g: DataFrame) -> DataFrame:
    """(game, period, ts, seq, clock, team, type, text, scoring, score_value, event_id) of game_time's rows: a play an
    event of a period."""
    g = g.filter("period is not null")
    w = Window.partitionBy("game", "period").orderBy("rank")
    g = g.withColumn("s", F.row_number().over(w) - 1).withColumn("left", F.count("*").over(Window.partitionBy("game", "period")) - 1 - F.col("s"))
    place = (F.col("s") % len(SCRIPT)).cast("int")
    at = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in SCRIPT]), place + 1)
    odd = F.floor(F.col("s") / len(SCRIPT)) % 2 == 1
    k = F.col("event_id") % 3
    own = F.coalesce(at(1), k == 0)  # a rebound in three is the shooter's
    what = at(0)
    team = F.when(own != odd, "Reds").otherwise("Blues")
    kind = (
        F.when(what == "miss", "JumpShot").when(what == "make", "LayUpShot").when(what == "shot", "JumpShot").when(what == "turnover", "Lost Ball Turnover").when(what == "steal", "Steal").when(what == "foul", F.when(k == 2, "Technical Foul").otherwise("PersonalFoul"))
        .when(what.startswith("throw"), "MadeFreeThrow").when(what == "pause", F.when(k == 0, "ShortTimeOut").otherwise("Substitution")).when(what == "rebound", F.when(own, "Offensive Rebound").when(k == 1, "Defensive Rebound").otherwise("Dead Ball Rebound")).otherwise("PersonalFoul")
    )
    made = F.col("event_id") % 2 == 0
    text = (
        F.when(what == "miss", "A misses three point jumper").when(what == "make", "A makes layup").when(what == "shot", F.when(made, "A makes three point jumper").otherwise("A misses jumper")).when(what == "turnover", "A turnover").when(what == "steal", "B steals")
        .when(what == "foul", F.when(k == 2, "A technical foul").otherwise("A shooting foul")).when(what == "throw 1", "B makes free throw 1 of 2").when(what == "throw 2", F.when(made, "B makes free throw 2 of 2").otherwise("B misses free throw 2 of 2"))
        .when(what == "pause", F.when(k == 0, "Timeout").otherwise("A subbing in")).otherwise("A")
    )
    clock = F.col("clock") + STEP * at(2)
    first, last = F.col("s") == 0, F.col("left") == 0
    kind, text, clock = F.when(first, "Jumpball").when(last, "End Period").otherwise(kind), F.when(first, "Jump Ball won by A").when(last, "End").otherwise(text), F.when(last, 0).otherwise(clock)
    scoring = text.contains(" makes ")
    return g.select("game", "period", "ts", F.col("s").alias("seq"), clock.cast("double").alias("clock"), F.when(~last, team).alias("team"), kind.alias("type"), text.alias("text"), scoring.alias("scoring"), F.when(text.contains("three"), 3).when(text.contains("free throw"), 1).otherwise(2).alias("score_value"), "event_id")


@query()
def pbp_intervals(spark, d):
    return S.intervals(plays(spark, d), keys=["game", "period"])


@query(
    f"""WITH {GAME}, p AS (SELECT game, period, event_id, event_id % 3 AS k, row_number() OVER (PARTITION BY game, period ORDER BY rank) - 1 AS s, count(*) OVER (PARTITION BY game, period) AS n FROM g WHERE period IS NOT NULL),
q AS (SELECT *, s % 11 AS c FROM p WHERE s > 0 AND s < n - 1)
SELECT game, CAST(count_if(c IN (0, 2, 10)) AS BIGINT) AS shots, CAST(count_if(c = 2 OR (c = 10 AND event_id % 2 = 0) OR c = 6 OR (c = 7 AND event_id % 2 = 0)) AS BIGINT) AS made, CAST(count_if(c = 3) AS BIGINT) AS turnovers,
  CAST(count_if(c IN (5, 9)) AS BIGINT) AS fouls, CAST(count_if(c = 1 AND k = 0) AS BIGINT) AS offensive_rebounds, CAST(count_if(c = 1 AND k = 1) AS BIGINT) AS defensive_rebounds, CAST(count_if(c IN (6, 7)) AS BIGINT) AS free_throws,
  CAST(count_if(c = 8 AND k = 0) AS BIGINT) AS timeouts, CAST(count_if(c = 8 AND k <> 0) AS BIGINT) AS substitutions, CAST(count_if(c = 4) AS BIGINT) AS steals FROM q GROUP BY game"""
)
def play_predicates(spark, d):
    text, kind = F.col("text"), F.col("type")
    tests = {
        "shots": X.is_shot(text), "made": X.is_made(text), "turnovers": X.is_turnover(kind, text), "fouls": X.is_foul(kind), "offensive_rebounds": X.rebound_kind(kind) == "offensive", "defensive_rebounds": X.rebound_kind(kind) == "defensive",
        "free_throws": X.is_free_throw(text), "timeouts": X.is_timeout(kind), "substitutions": X.is_substitution(kind, text), "steals": X.is_steal(kind),
    }
    inner = plays(spark, d).filter(~kind.isin("Jumpball", "End Period"))
    return inner.groupBy("game").agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])


# --- records ------------------------------------------------------------------------------------------------------

FRAMES_A_SECOND, LENGTH = 2, 50


def records_input(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plays, cleaned reads, spans, possessions (eleven plays each, the teams in turn) and points. Five Reds stand in the
    half that they attack, the left one but for the second period; where an event's number is odd they run to and fro for
    its four seconds. Five Blues are seen once a second.

    The games and what is of an event's size are stored, for each is read by several branches: with the windows that make
    them repeated in every branch, the plans and their compiled code filled the driver's memory. Points, sixty times the
    events, are derived where they are read.
    """
    whole = checkpointed(game_time(spark, d))
    g = whole.filter("period is not null")
    block = F.floor((F.row_number().over(Window.partitionBy("game", "period").orderBy("rank")) - 1) / len(SCRIPT)).cast("int")
    g = checkpointed(g.select("game", "period", "second", "event_id", (F.col("period") * 1000 + block).alias("possession")))
    reads = known_timeline(whole).filter("clock is not null").select("game", "t", "clock")
    spans = g.select("game", "period").distinct().join(spark.createDataFrame([(n, float(a), float(a + size)) for n, a, size in PERIODS], "period int, t_lo double, t_hi double"), "period").select("game", "period", "t_lo", "t_hi")
    reds, turned = F.col("possession") % 2 == 0, F.col("period") == 2
    possessions = g.groupBy("game", "period", "possession").agg(F.min("second").cast("double").alias("start_time"), (F.max("second") + STEP - 0.01).alias("end_time"))
    possessions = possessions.select("game", "possession", "start_time", "end_time", F.when(reds, "Reds").otherwise("Blues").alias("offense_team"), F.when(reds == turned, "right").otherwise("left").alias("attacking_basket"))
    frames = g.select("game", "period", "possession", "second", (F.col("event_id") % 2 == 1).alias("runs"), F.explode(F.sequence(F.lit(0), F.lit(STEP * FRAMES_A_SECOND - 1))).alias("k"))
    p = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("track")).filter((F.col("track") < 5) | (F.col("k") % FRAMES_A_SECOND == 0))
    place = F.col("track") % 5
    x, y = 40.0 - 6.0 * place, 25.0 + 4.0 * place - F.when(place > 2, 30).otherwise(0) + F.when(F.col("runs") & (F.col("k") % 2 == 1), 2.5).otherwise(0.0)
    points = p.select(
        "game", "possession", F.col("track").cast("long").alias("track"), F.when(F.col("track") < 5, "Reds").otherwise("Blues").alias("team"), F.when(F.col("track") == 0, "P0").alias("name"), F.lit("1").alias("jersey"), (F.col("second") + F.col("k") / FRAMES_A_SECOND).alias("t"),
        F.when(turned, 94.0 - x).otherwise(x).alias("x"), y.alias("y"), (F.col("k") % 3 > 0).alias("detected"), (F.col("track") == 0).alias("holding"), F.lit(LENGTH).alias("length"),
    )
    return checkpointed(plays_of(whole)), checkpointed(reads), checkpointed(spans), checkpointed(possessions), points


@query()
def halfcourt_records(spark, d):
    made, reads, spans, possessions, points = records_input(spark, d)
    r = H.build_records(made, reads, spans, possessions, points, team="Reds")
    return r.select("key", "start_type", "full_court", "terminal", "start_clock", "end_clock", "located", "outcome", "points", "t0", "setup", "no_setup", "transition", F.size(F.coalesce("players", F.expr("array()"))).alias("n_players"))


@query()
def coverage_report(spark, d):
    r = checkpointed(halfcourt_records(spark, d)).withColumn("game", F.split_part("key", F.lit(":"), F.lit(1)))
    return R.period_coverage(r, ["game"]).select("game", "intervals", "located", "dead_ball", "dead_ball_with_setup", F.map_keys("start_types").alias("kinds"))


@query()
def setup_grid(spark, d):
    """Set-ups found for each pair of thresholds, over the records of halfcourt_records."""
    made, reads, spans, possessions, points = records_input(spark, d)
    directions = H.attack_directions(possessions, spans)
    iv = checkpointed(H.located_intervals(made, reads, spans, team="Reds"))
    rows = checkpointed(H.gathered(iv, possessions, points, directions))
    return H.setup_sensitivity(iv, rows, radii=[1.0, 1.5, 3.0], players=[3, 4, 5])


@query(
    f"""WITH {GAME}, f AS (SELECT game, rank, h % 5 <> 0 AS ok FROM g), r AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY rank) AS k FROM f),
runs AS (SELECT game, k, count(*) AS n FROM r WHERE ok GROUP BY game, k)
SELECT game, CAST(count(*) AS BIGINT) AS runs, round(median(n) / 10.0, 6) AS median, round(max(n) / 10.0, 6) AS longest, CAST(count_if(n >= 8) AS BIGINT) AS long FROM runs GROUP BY game"""
)
def run_statistics(spark, d):
    """Runs of valid rows over chunks of sixty: each chunk is reduced on its own, runs that cross borders count once."""
    g = game_time(spark, d).withColumn("chunk", F.floor(F.col("rank") / 60))
    states = W.chunk_runs(g, keys=["game"], chunk="chunk", order="rank", flag=F.col("h") % 5 != 0)
    return R.run_stats(W.merged_runs(states, keys=["game"], chunk="chunk"), ["game"], fps=10.0, least=0.8)


@query(
    f"""WITH {GAME}, c AS (SELECT game, h AS reading, count(*) AS n, min(rank) AS first FROM g GROUP BY game, h)
SELECT game, reading, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY game ORDER BY n DESC, first, reading) AS INT) AS rank FROM c QUALIFY rank <= 15"""
)
def common_readings(spark, d):
    g = game_time(spark, d).withColumn("reading", F.col("h"))
    return R.most_common(g, ["game"], "reading", at_order="rank")


def defence_plays(spark, d) -> DataFrame:
    """(play, man, second): the events of the games' possessions; man is the defence that is played."""
    g = game_time(spark, d).filter("period is not null")
    block = F.floor((F.row_number().over(Window.partitionBy("game", "period").orderBy("rank")) - 1) / len(SCRIPT)).cast("int")
    return g.select((F.col("game") * 100_000 + F.col("period") * 1000 + block).cast("long").alias("play"), "second").select("play", (F.pmod(F.xxhash64("play"), F.lit(2)) == 0).alias("man"), "second")


def defence_points(spark, d) -> DataFrame:
    return points_of(defence_plays(spark, d))


def points_of(g: DataFrame) -> DataFrame:
    """(play, man, t, side, track, x, y) of defence_plays' rows: the possessions, seen once a second. The five who attack
    run in circles; of two possessions the defenders of one (man) stand three feet from their opponents on the way to the
    rim, those of the other keep to places of their own, with a step to either side."""
    f = g.select("play", "man", F.explode(F.sequence(F.col("second"), F.col("second") + STEP - 1)).alias("t")).withColumn("t", F.col("t").cast("double")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4))))
    turn = F.col("t") * 0.7 + F.col("i") * 1.2566
    ax, ay = 26.0 + 12.0 * F.cos(turn) + F.col("i"), 25.0 + 14.0 * F.sin(turn)
    away = F.hypot(ax - 5.25, ay - 25.0)
    near = lambda v, rim: v + 3.0 * (F.lit(rim) - v) / away
    step = F.when(F.col("t").cast("long") % 2 == 0, 0.4).otherwise(-0.4)
    zx, zy = 10.0 + 6.0 * (F.col("i") % 3) + step, 11.0 + 7.0 * F.col("i") + step
    sides = F.array(
        F.struct(F.lit("off").alias("side"), F.col("i").cast("long").alias("track"), ax.alias("x"), ay.alias("y")),
        F.struct(F.lit("def").alias("side"), (F.col("i") + 5).cast("long").alias("track"), F.when(F.col("man"), near(ax, 5.25)).otherwise(zx).alias("x"), F.when(F.col("man"), near(ay, 25.0)).otherwise(zy).alias("y")),
    )
    return f.select("play", "man", "t", F.inline(sides))


@query()
def defence_labels(spark, d):
    """Man or zone of every possession, with the defence that was played."""
    g = checkpointed(defence_plays(spark, d))  # points, forty times as many, are derived where they are read
    p = points_of(g)
    pairs = checkpointed(TR.matchups(p, keys=["play", "t"]))
    measures = checkpointed(FE.defence_measures(pairs, p, key="play"))
    labels = K.two_way_labels(measures, id_="play", measures=["stability", "follow", "spread", "gap", "paint"], higher=["stability", "follow"], names=("man", "zone"))
    return labels.join(g.select("play", "man").distinct(), "play").select("play", "man", "label", F.round("confidence", 5).alias("confidence"))


# --- streams ------------------------------------------------------------------------------------------------------

PARTS = 4


@query()
def stream_clock(spark, d):
    """The reads of score_timeline_known as a stream in four parts, each run from the checkpoint of the one before."""
    reads, states = _in_periods(scoreboard(spark, d)), score_states(spark, d)
    run = lambda rows: M.clean_timeline_stream(rows, keys=["game", "period"], ts="ts", late="1 hour", idle=LONG, states=states)
    return ST.run_parts(ST.in_parts(reads, PARTS), run, name="clock")


@query()
def stream_intervals(spark, d):
    """The plays of pbp_intervals as a stream in four parts."""
    rows = plays(spark, d).select("game", "period", "ts", "seq", "clock", "team", "type", "text")
    return ST.run_parts(ST.in_parts(rows, PARTS), lambda r: M.intervals_stream(r, keys=["game", "period"], ts="ts", late="1 hour", idle=LONG), name="intervals")


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(*names):
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    rows = ST.run_parts(ST.in_parts(_events(spark, d), PARTS), lambda e: ST.tumbling(ST.with_watermark(e), keys=["event_type"]), name="tumbling")
    return rows.select(*_naive("start"), "event_type", "n", "total")


_LATE = """WITH x AS (SELECT *, event_id % 50 = 7 AS held FROM events), wm AS (SELECT max(ts) FILTER (WHERE NOT held) - INTERVAL 1 HOUR AS w FROM x),
e AS (SELECT x.*, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, w FROM x, wm),
k AS (SELECT * FROM e WHERE NOT held OR date_trunc('millisecond', w) < start + INTERVAL 1 DAY)
SELECT CAST(start AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, CAST((SELECT count(*) FROM e) - (SELECT count(*) FROM k) AS BIGINT) AS late FROM k GROUP BY start, event_type"""


@query(_LATE)
def stream_late(spark, d):
    """One event in fifty comes only after all others: those of windows that the watermark has closed by then are left
    out and counted."""
    e = _events(spark, d)
    held = F.col("event_id") % 50 == 7
    rows = ST.run_parts([*ST.in_parts(e.filter(~held), PARTS), e.filter(held)], lambda r: ST.tumbling(ST.with_watermark(r), keys=["event_type"]), name="late")
    counted = rows.agg(F.sum("n").alias("_n")).crossJoin(e.agg(F.count("*").alias("_all")))  # one row each
    return rows.crossJoin(F.broadcast(counted)).select(*_naive("start"), "event_type", "n", "total", (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("late"))


@query("SELECT CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY * k AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events, range(2) r(k) GROUP BY ALL")
def stream_sliding(spark, d):
    rows = ST.run_parts(ST.in_parts(_events(spark, d), PARTS), lambda e: ST.sliding(ST.with_watermark(e), keys=["event_type"]), name="sliding")
    return rows.select(*_naive("start"), "event_type", "n")


_SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o), g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, sid)
SELECT user_id, start, "end", CAST(n AS BIGINT) AS n FROM g"""


@query(_SESSIONS)
def stream_sessions(spark, d):
    rows = ST.run_parts(ST.in_parts(_events(spark, d), PARTS), lambda e: ST.sessions(ST.with_watermark(e), keys=["user_id"]), name="sessions")
    return rows.select("user_id", *_naive("start", "end"), "n")


@query(_SESSIONS)
def batch_sessions(spark, d):
    return ST.sessions(_events(spark, d), keys=["user_id"]).select("user_id", *_naive("start", "end"), "n")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_state(spark, d):
    """The newest state of each key, in update mode."""
    e = ST.event_stream(spark, d, table(spark, d, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = ST.run_available(ST.latest_by_key(e, key="user_id"), name="state", mode="update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


@query("SELECT user_id, CAST(sum(new) AS BIGINT) AS runs FROM (SELECT user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) = event_type THEN 0 ELSE 1 END AS new FROM events) GROUP BY user_id")
def stream_runs(spark, d):
    return ST.run_parts(ST.in_parts(_events(spark, d), PARTS), lambda e: M.runs_of_labels(e, key="user_id"), name="runs").filter("user_id is not null")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT user_id, event_type, ts FROM events) GROUP BY ALL")
def stream_dedup(spark, d):
    """Every event comes twice; an hour after the watermark has passed it, it is forgotten."""
    e = _events(spark, d).select("user_id", "event_type", "ts")
    rows = ST.run_parts([p.unionAll(p) for p in ST.in_parts(e, PARTS)], lambda r: ST.first_seen(ST.with_watermark(r), keys=["user_id", "event_type", "ts"]), name="dedup")
    return rows.filter("user_id is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
