"""Queries that run the operators over the given tables, and the SQL that checks them.

`court` reads the table events as tracking data: a user is a game, an event a player seen on the court.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import court as C
from .functions import text as X
from .operators import features as FE
from .operators import joins as J
from .operators import votes as V
from .operators import windows as W
from .plans import spec
from .sources import files as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def court(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return e.select(
        "event_id", F.col("user_id").alias("game"), ms.alias("t_ms"), (ms / 1000.0).alias("t"), ((F.col("event_id") * 37) % 940 / 10.0).alias("x"), ((F.col("event_id") * 53) % 500 / 10.0).alias("y"),
        F.when((F.col("event_id") * 37) % 940 < 470, -1).otherwise(1).alias("half"), (F.col("event_id") % 2).cast("int").alias("cluster"), "event_type", "value",
    )


COURT = """v AS (SELECT event_id, user_id AS game, epoch_us(ts) // 1000 AS t_ms, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t,
  ((event_id * 37) % 940) / 10.0::DOUBLE AS x, ((event_id * 53) % 500) / 10.0::DOUBLE AS y, CASE WHEN (event_id * 37) % 940 < 470 THEN -1 ELSE 1 END AS half,
  CAST(event_id % 2 AS INT) AS cluster, event_type, value FROM events)"""
_EDGES = "".join(f" WHEN d < {edge} THEN {k}" for k, edge in enumerate(spec.RINGS))
ZONED = (
    COURT
    + f""", zd AS (SELECT *, sqrt((x - 5.25) * (x - 5.25) + (y - 25.0) * (y - 25.0)) AS d, greatest(-90.0, least(90.0, degrees(atan2(y - 25.0, x - 5.25)))) AS a FROM v),
z AS (SELECT *, CAST(CASE WHEN x >= 47 THEN 21 ELSE coalesce((CASE{_EDGES} END) * 5 + least(4, floor((a + 90.0) / 36.0)), 20) END AS INT) AS zone FROM zd)"""
)


def zoned(spark, sf_dir):
    return court(spark, sf_dir).withColumn("zone", C.zone_of(F.col("x"), F.col("y")))


@query(f"WITH {ZONED} SELECT zone, CAST(count(*) AS BIGINT) AS n, round(avg(d), 6) AS mean_distance FROM z GROUP BY zone")
def zone_histogram(spark, d):
    return zoned(spark, d).groupBy("zone").agg(F.count("*").alias("n"), F.round(F.avg(C.rim_distance(F.col("x"), F.col("y"))), 6).alias("mean_distance"))


_NAMES = ", ".join(f"'{n}'" for n in spec.ZONE_NAMES)


@query(f"WITH {ZONED} SELECT [{_NAMES}][zone + 1] AS zone_name, event_type, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY ALL")
def zone_by_type(spark, d):
    return zoned(spark, d).groupBy(C.zone_name(F.col("zone")).alias("zone_name"), "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {ZONED} SELECT game, list(n ORDER BY k) AS occupancy FROM (SELECT g.game, k, CAST(count(z.zone) AS DOUBLE) AS n FROM (SELECT DISTINCT game FROM v) g CROSS JOIN range(22) r(k) LEFT JOIN z ON z.game = g.game AND z.zone = k GROUP BY g.game, k) GROUP BY game")
def zone_occupancy(spark, d):
    return zoned(spark, d).groupBy("game").agg(C.occupancy(F.col("zone")).alias("occupancy"))


@query(f"WITH {COURT} SELECT event_id, CASE WHEN cluster = 0 THEN x ELSE 94.0 - x END AS cx, y BETWEEN 1.0 AND 49.0 AND x BETWEEN 1.0 AND 93.0 AS inside, CAST(round_even(x * 10 + 20, 0) AS INT) AS px FROM v")
def mirror_inside_court(spark, d):
    basket = F.when(F.col("cluster") == 0, "left").otherwise("right")
    return court(spark, d).select("event_id", C.mirrored_x(F.col("x"), basket).alias("cx"), C.inside_court(F.col("x"), F.col("y"), -1.0).alias("inside"), C.to_pixel(F.col("x"), 10, 20).alias("px"))


H = [1.2, 0.1, 3.0, -0.05, 0.9, 2.0, 0.0008, 0.0004, 1.0]


@query(
    f"""WITH {COURT}, p AS (SELECT event_id, x, y, ({H[6]} * x + {H[7]} * y + {H[8]}) AS w FROM v)
SELECT event_id, round(({H[0]} * x + {H[1]} * y + {H[2]}) / w, 5) AS hx, round(({H[3]} * x + {H[4]} * y + {H[5]}) / w, 5) AS hy, round(x, 4) AS back_x, round(y, 4) AS back_y FROM p"""
)
def homography_project(spark, d):
    h = F.array(*map(F.lit, H))
    hx, hy = C.project(h, F.col("x"), F.col("y"))
    rows = court(spark, d).select("event_id", hx.alias("hx"), hy.alias("hy"))
    bx, by = C.project(C.inverse(h), F.col("hx"), F.col("hy"))
    return rows.select("event_id", F.round("hx", 5).alias("hx"), F.round("hy", 5).alias("hy"), (F.round(bx, 4) + 0.0).alias("back_x"), (F.round(by, 4) + 0.0).alias("back_y"))


@query(
    f"""WITH {COURT} SELECT event_id, [round(q, 6) FOR q IN [x - 2.0 * .4, y - 1.0 * .4, x + 2.0 * .4, y + 1.0 * .4]] AS small, x AS foot_x, y + 1.0 AS foot_y,
[CAST(greatest(0, least(90, round_even(x - 2.0, 0))) AS INT), CAST(greatest(0, least(40, round_even(y - 1.0, 0))) AS INT), CAST(greatest(0, least(90, round_even(x + 2.0, 0))) AS INT), CAST(greatest(0, least(40, round_even(y + 1.0, 0))) AS INT)] AS crop FROM v"""
)
def box_arithmetic(spark, d):
    box = F.array(F.col("x") - 2.0, F.col("y") - 1.0, F.col("x") + 2.0, F.col("y") + 1.0)
    foot_x, foot_y = C.bottom_center(box)
    small = F.transform(C.shrunk_box(box), lambda v: F.round(v, 6) + 0.0)
    return court(spark, d).select("event_id", small.alias("small"), foot_x.alias("foot_x"), foot_y.alias("foot_y"), C.clamped_box(box, 90, 40).alias("crop"))


_SEGMENTS = (
    COURT
    + """, s AS (SELECT *, CASE WHEN lag(t) OVER o IS NULL OR lag(half) OVER o <> half OR t - lag(t) OVER o > 43200 THEN 1 ELSE 0 END AS new FROM v WINDOW o AS (PARTITION BY game ORDER BY t, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY game ORDER BY t, event_id) AS run FROM s),
runs AS (SELECT game, run, half, min(t) AS t_lo, max(t) AS t_hi, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT *, CASE WHEN lag(half) OVER o IS NULL OR lag(half) OVER o <> half OR t_lo - lag(t_hi) OVER o > 172800 THEN 1 ELSE 0 END AS new FROM runs WINDOW o AS (PARTITION BY game ORDER BY run)),
g AS (SELECT *, sum(new) OVER (PARTITION BY game ORDER BY run) AS seg FROM m),
merged AS (SELECT game, seg, half, min(t_lo) AS t_lo, max(t_hi) AS t_hi, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL),
segs AS (SELECT game, half, t_lo, t_hi, n, t_hi - t_lo AS duration, CAST(row_number() OVER (PARTITION BY game ORDER BY seg) AS INT) AS segment FROM merged WHERE t_hi - t_lo >= 3600)"""
)


def _segments(spark, d):
    return W.segments(court(spark, d), key="game", t="t", label="half", max_gap=43200, merge_gap=172800, min_duration=3600, tie="event_id")


@query(f"WITH {_SEGMENTS} SELECT game, segment, half, t_lo, t_hi, n, round(duration, 3) AS duration FROM segs")
def possession_segments(spark, d):
    return _segments(spark, d).select("game", "segment", "half", "t_lo", "t_hi", "n", F.round("duration", 3).alias("duration"))


@query(f"WITH {_SEGMENTS} SELECT half, CAST(count(*) AS BIGINT) AS segments, round(sum(duration), 3) AS seconds, round(median(duration), 3) AS middle, max(n) AS longest FROM segs GROUP BY half")
def segment_rollup(spark, d):
    return _segments(spark, d).groupBy("half").agg(F.count("*").alias("segments"), F.round(F.sum("duration"), 3).alias("seconds"), F.round(F.median("duration"), 3).alias("middle"), F.max("n").alias("longest"))


@query(
    f"""WITH {COURT} SELECT game, CASE WHEN count_if((half = 1 AND cluster = 0) OR (half = -1 AND cluster = 1)) > count_if((half = 1 AND cluster = 1) OR (half = -1 AND cluster = 0)) THEN 0 ELSE 1 END AS right_team, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY game"""
)
def half_vote_map(spark, d):
    return V.offense_map(court(spark, d), ["game"])


@query(
    f"""WITH {COURT}, c AS (SELECT game, event_type, count(*) AS n, min(t_ms) AS f FROM v GROUP BY ALL)
SELECT game, event_type, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY game ORDER BY n DESC, f) AS k FROM c) WHERE k = 1"""
)
def track_majority(spark, d):
    return V.first_seen_majority(court(spark, d), ["game"], "event_type", "t_ms")


@query(
    f"""WITH {COURT}, c AS (SELECT game, event_id % 100 AS number, count(*) AS n FROM v GROUP BY ALL),
r AS (SELECT *, max(n) OVER (PARTITION BY game) AS votes FROM c), k AS (SELECT game, votes, count(*) AS tied, min(number) AS number FROM r WHERE n = votes GROUP BY ALL)
SELECT game, CAST(votes AS BIGINT) AS votes, CASE WHEN votes >= 2 AND tied = 1 THEN number END AS winner FROM k"""
)
def plurality_min_votes(spark, d):
    return V.plurality(court(spark, d).withColumn("number", F.col("event_id") % 100), ["game"], "number", 2)


@query(
    f"""WITH {COURT}, p AS (SELECT game, event_id, t FROM v WHERE event_type = 'purchase'), w AS (SELECT game, t, value FROM v WHERE event_type = 'view'),
j AS (SELECT p.game, p.event_id, w.value, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - w.t), w.t) AS k FROM p JOIN w ON p.game = w.game AND abs(p.t - w.t) <= 21600.000000001)
SELECT p.game, p.event_id, j.value FROM p LEFT JOIN j ON p.event_id = j.event_id AND k = 1"""
)
def nearest_value_within(spark, d):
    v = court(spark, d)
    left, right = v.filter("event_type = 'purchase'").select("game", "event_id", "t"), v.filter("event_type = 'view'").select("game", "t", "value")
    return J.nearest_within(left, right, keys=["game"], left_t="t", right_t="t", value="value", tolerance=21600, left_id=["game", "event_id"]).select("game", "event_id", "value")


_CLOCKS = """reads AS (SELECT game, t_ms / 1000.0::DOUBLE AS t, 1200.0 - ((t_ms // 1000) % 86400) / 72.0::DOUBLE AS clock, (t_ms // 86400000) AS day FROM v),
targets AS (SELECT DISTINCT game, day, day * 100 + k AS target_id, 150.0 * k AS clock, day * 86400.0::DOUBLE AS t_lo, (day + 1) * 86400.0::DOUBLE AS t_hi FROM reads CROSS JOIN range(1, 8) r(k))"""


@query(
    f"""WITH {COURT}, {_CLOCKS},
j AS (SELECT q.game, target_id, q.clock AS want, r.t, r.clock FROM targets q JOIN reads r ON q.game = r.game AND r.t BETWEEN t_lo AND t_hi),
s AS (SELECT game, target_id, want, min(CASE WHEN abs(clock - want) <= 5 THEN t END) AS exact, max(CASE WHEN clock > want + 5 THEN t END) AS up FROM j GROUP BY ALL),
b AS (SELECT s.game, s.target_id, min(j.t) AS bt FROM s JOIN j ON s.game = j.game AND s.target_id = j.target_id WHERE j.clock < s.want - 5 AND j.t > s.up GROUP BY ALL)
SELECT q.game, q.target_id, coalesce(exact, CASE WHEN bt - up <= 20000 THEN round(up + (bt - up) * (ra.clock - want) / (ra.clock - rb.clock), 2) END) AS t
FROM targets q LEFT JOIN s ON q.game = s.game AND q.target_id = s.target_id LEFT JOIN b ON s.game = b.game AND s.target_id = b.target_id
LEFT JOIN reads ra ON ra.game = s.game AND ra.t = s.up LEFT JOIN reads rb ON rb.game = s.game AND rb.t = b.bt"""
)
def clock_to_video_interp(spark, d):
    second = F.floor(F.col("t_ms") / 1000)
    reads = court(spark, d).select("game", "t", (1200.0 - (second % 86400) / 72.0).alias("clock"), F.floor(F.col("t_ms") / 86400000).alias("day"))
    targets = reads.select("game", "day").distinct().select("game", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"), "day")
    targets = targets.select("game", (F.col("day") * 100 + F.col("k")).alias("target_id"), (150.0 * F.col("k")).alias("clock"), (F.col("day") * 86400.0).alias("t_lo"), ((F.col("day") + 1) * 86400.0).alias("t_hi"))
    return J.clock_to_video(targets, reads, keys=["game"], mode="first", max_gap=20000, band=5).select("game", "target_id", "t")


@query(
    """WITH w AS (SELECT o_custkey, o_orderkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS lo FROM orders)
SELECT a.o_orderkey AS a, b.o_orderkey AS b, CAST(greatest(a.lo, b.lo) AS BIGINT) AS from_day FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.lo + 45 >= b.lo AND b.lo + 45 >= a.lo"""
)
def interval_overlap_join(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86400000000).cast("long").alias("lo")).withColumn("hi", F.col("lo") + 45)
    l, r = o.select("o_custkey", F.col("o_orderkey").alias("a"), "lo", "hi"), o.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))  # noqa: E741
    return J.overlapping(l, r, keys=["o_custkey"], left_range=("lo", "hi"), right_range=("lo2", "hi2"), width=90).filter("a < b").select("a", "b", F.greatest("lo", "lo2").alias("from_day"))


@query(
    """WITH w AS (SELECT o_custkey AS game, o_orderkey AS window_id, (o_orderkey % 37) * 30.0 AS lo, (o_orderkey % 37) * 30.0 + 40.0 AS hi, CASE WHEN o_orderpriority < '3' THEN 'A' ELSE 'B' END AS team FROM orders),
e AS (SELECT o_custkey AS game, l_orderkey * 10 + l_linenumber AS event_id, ((l_partkey * 7) % 1200)::DOUBLE AS clock, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS team, l_linestatus = 'O' AS offensive, l_linenumber % 2 = 0 AS dead FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT e.*, w.window_id, w.lo, w.hi, coalesce(w.team = e.team, false) AS same FROM e JOIN w ON e.game = w.game),
s AS (SELECT game, event_id, dead,
 min(window_id) FILTER (WHERE ar AND same) AS o0, max(window_id) FILTER (WHERE ar AND same) AS o1, min(window_id) FILTER (WHERE ar AND same AND st) AS o2, max(window_id) FILTER (WHERE ar AND same AND st) AS o3,
 min(window_id) FILTER (WHERE ar) AS a0, max(window_id) FILTER (WHERE ar) AS a1, min(window_id) FILTER (WHERE ar AND st) AS a2, max(window_id) FILTER (WHERE ar AND st) AS a3,
 min({'d': lo - clock, 'w': window_id}) FILTER (WHERE offensive AND same AND hi >= clock AND lo - clock <= 12) AS recent
 FROM (SELECT *, clock BETWEEN lo - 1 AND hi + 1 AS ar, lo < clock AND clock < hi AS st FROM j) GROUP BY ALL)
SELECT * FROM (SELECT game, event_id, CASE WHEN o0 IS NOT NULL THEN CASE WHEN o2 = o3 THEN o2 WHEN dead THEN o1 ELSE o0 END WHEN recent IS NOT NULL THEN recent.w WHEN a2 = a3 THEN a2 WHEN dead THEN a1 ELSE a0 END AS window_id FROM s) WHERE window_id IS NOT NULL"""
)
def priority_assign(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    lo = (F.col("o_orderkey") % 37) * 30.0
    w = o.select(F.col("o_custkey").alias("game"), F.col("o_orderkey").alias("window_id"), lo.alias("lo"), (lo + 40.0).alias("hi"), (lo + 40.0).alias("start"), F.when(F.col("o_orderpriority") < "3", "A").otherwise("B").alias("team"))
    e = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("game"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), ((F.col("l_partkey") * 7) % 1200).cast("double").alias("clock"),
        F.when(F.col("l_returnflag") == "N", None).when(F.col("l_returnflag") == "A", "A").otherwise("B").alias("team"), (F.col("l_linestatus") == "O").alias("offensive"), (F.col("l_linenumber") % 2 == 0).alias("dead"),
    )
    return J.assign_to_windows(w, e, keys=["game"])


_DAY0 = 1704067200.0
_SPANS = [(1, _DAY0 + 86400, _DAY0 + 5 * 86400), (2, _DAY0 + 5 * 86400, _DAY0 + 11 * 86400), (3, _DAY0 + 12 * 86400, _DAY0 + 20 * 86400)]


@query(
    f"""WITH {COURT}, spans(span, t_lo, t_hi) AS (VALUES {", ".join(map(str, _SPANS))}),
i AS (SELECT event_id, min(span) AS span FROM v JOIN spans ON t >= t_lo AND t < t_hi GROUP BY event_id),
n AS (SELECT event_id, span, row_number() OVER (PARTITION BY event_id ORDER BY least(abs(t - t_lo), abs(t - t_hi)), span) AS k, least(abs(t - t_lo), abs(t - t_hi)) AS d FROM v CROSS JOIN spans)
SELECT v.event_id, coalesce(i.span, CASE WHEN n.d <= 43200 THEN n.span END) AS span FROM v LEFT JOIN i USING (event_id) JOIN n ON v.event_id = n.event_id AND k = 1"""
)
def span_containing_or_near(spark, d):
    spans = spark.createDataFrame(_SPANS, "span int, t_lo double, t_hi double")
    return J.span_of(court(spark, d), spans, t="t", near=43200).select("event_id", "span")


@query(f"WITH {COURT} SELECT event_id, game FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE b.event_type = 'purchase' AND b.game = a.game AND b.t_ms // 3600000 = a.t_ms // 3600000)")
def holding_semi_join(spark, d):
    v = court(spark, d).withColumn("hour", F.floor(F.col("t_ms") / 3600000))
    return J.having(v, v.filter("event_type = 'purchase'"), ["game", "hour"]).select("event_id", "game")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def unlocated_anti_join(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.lacking(table(spark, d, "orders").select("o_orderkey", "o_custkey"), big, ["o_orderkey"])


_FRAMES = """f AS (SELECT game, t_ms // 86400000 AS day, list({'x': x, 'y': y} ORDER BY event_id) AS p FROM v GROUP BY ALL)"""


def _frames(spark, d):
    return court(spark, d).groupBy("game", F.floor(F.col("t_ms") / 86400000).alias("day")).agg(F.sort_array(F.collect_list(F.struct("event_id", "x", "y"))).alias("_e")).select("game", "day", F.transform("_e", lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"))).alias("p"))


@query(
    f"""WITH {COURT}, {_FRAMES}, j AS (SELECT a.game, a.day, a.p, b.p AS old FROM f a LEFT JOIN f b ON a.game = b.game AND a.day = b.day + 1)
SELECT game, day::DOUBLE AS day, CAST(len(p) AS INT) AS visible, CAST(CASE WHEN old IS NULL THEN 0 ELSE len(list_filter(p, lambda q: len(list_filter(old, lambda o: sqrt((q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y)) < 15)) > 0)) END AS INT) AS still, CAST(len(list_filter(p, lambda q: q.x < 47)) AS INT) AS frontcourt FROM j"""
)
def still_frames(spark, d):
    return W.still_counts(_frames(spark, d).withColumn("day", F.col("day").cast("double")), key="game", t="day", points="p", back=1.0, tolerance=0.1, radius=15.0)


_GREEDY = """groups AS (SELECT DISTINCT game, day FROM r), k(game, day, i, kept) AS (SELECT game, day, 0, CAST([] AS STRUCT(event_id BIGINT, x DOUBLE, y DOUBLE)[]) FROM groups
UNION ALL SELECT k.game, k.day, i + 1, CASE WHEN len(list_filter(kept, lambda q: sqrt((q.x - r.x) ** 2 + (q.y - r.y) ** 2) < {apart})) > 0 THEN kept ELSE list_append(kept, {{'event_id': r.event_id, 'x': r.x, 'y': r.y}}) END FROM k JOIN r ON r.game = k.game AND r.day = k.day AND r.n = k.i + 1),
last AS (SELECT game, day, arg_max(kept, i) AS kept FROM k GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {COURT}, r AS (SELECT game, t_ms // 86400000 AS day, event_id, x, y, row_number() OVER (PARTITION BY game, t_ms // 86400000 ORDER BY cluster = 0, -value, event_id) AS n FROM v),
{_GREEDY.format(apart=12)} SELECT game, CAST(day AS BIGINT) AS day, [q.event_id FOR q IN kept[:5]] AS kept, CAST(len(kept) AS INT) AS merged FROM last"""
)
def ranked_dedup_cap5(spark, d):
    p = F.collect_list(F.struct((F.col("cluster") == 0).alias("undetected"), (-F.col("value")).alias("length"), "event_id", "x", "y"))
    frames = court(spark, d).groupBy("game", F.floor(F.col("t_ms") / 86400000).alias("day")).agg(p.alias("_p"))
    kept = W.ranked_dedup(F.col("_p"), apart=12.0, cap=5)
    return frames.select("game", "day", F.transform(kept, lambda q: q["event_id"]).alias("kept"), F.size(W.ranked_dedup(F.col("_p"), apart=12.0, cap=None)).alias("merged"))


@query(
    """WITH r AS (SELECT l_orderkey, l_suppkey % 3 AS team, l_partkey % 8 AS track, l_shipdate, l_returnflag = 'R' AS named, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 3 ORDER BY (l_returnflag = 'R') DESC, l_quantity DESC, l_partkey % 8, l_linenumber) AS k FROM lineitem)
SELECT l_orderkey, track, CAST(count_if(k > 1) AS BIGINT) AS surplus, CAST(count(*) AS BIGINT) AS frames, count_if(k > 1) / count(*) > .5 AND NOT bool_or(named) AS demoted FROM r GROUP BY l_orderkey, track"""
)
def team_cap_surplus(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 3).alias("team"), (F.col("l_partkey") % 8).alias("track"), F.lit(0).alias("t"), (F.col("l_returnflag") == "R").alias("named"), F.struct("l_quantity", (-(F.col("l_partkey") % 8)).alias("p"), (-F.col("l_linenumber")).alias("n")).alias("length"))
    return V.capped_team(rows, keys=["l_orderkey"], cap=1)


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE coalesce(p, 'O') <> o_orderstatus")
def change_points(spark, d):
    return W.change_points(table(spark, d, "orders"), key="o_custkey", order=["o_orderdate", "o_orderkey"], values=["o_orderstatus"], start=["O"]).select("o_custkey", "o_orderkey", "o_orderstatus")


_PLAYS = """plays AS (SELECT event_id, 'P' || (event_id % 7) || CASE event_id % 6 WHEN 0 THEN ' made Layup. Assisted by Q' || (event_id % 5) || ' Jr.' WHEN 1 THEN ' missed Three Point Jumper.' WHEN 2 THEN ' makes free throw 1 of 2' WHEN 3 THEN ' Turnover.' WHEN 4 THEN ' Missed Dunk' ELSE ' Defensive Rebound.' END AS raw, CASE event_id % 6 WHEN 5 THEN 'Defensive Rebound' WHEN 3 THEN 'Lost Ball Turnover' WHEN 2 THEN 'MadeFreeThrow' ELSE 'JumpShot' END AS type FROM events)"""
_NORMAL = "regexp_replace(regexp_replace(regexp_replace(raw, '\\bmade\\b', 'makes', 'gi'), '\\bmissed\\b', 'misses', 'gi'), '\\.?\\s*Assisted by (.+)\\.\\s*$', ' (\\1 assists)')"
for _noun in X.SHOT_NOUNS:
    _NORMAL = f"regexp_replace({_NORMAL}, '{_noun}', '{_noun.lower()}', 'gi')"


def _plays(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 6
    s = lambda c: c.cast("string")
    tail = F.when(k == 0, F.concat(F.lit(" made Layup. Assisted by Q"), s(F.col("event_id") % 5), F.lit(" Jr."))).when(k == 1, " missed Three Point Jumper.").when(k == 2, " makes free throw 1 of 2").when(k == 3, " Turnover.").when(k == 4, " Missed Dunk").otherwise(" Defensive Rebound.")
    kind = F.when(k == 5, "Defensive Rebound").when(k == 3, "Lost Ball Turnover").when(k == 2, "MadeFreeThrow").otherwise("JumpShot")
    return e.select("event_id", "user_id", F.concat(F.lit("P"), s(F.col("event_id") % 7), tail).alias("raw"), kind.alias("type"))


@query(f"WITH {_PLAYS} SELECT event_id, {_NORMAL} AS text FROM plays")
def event_text_normalize(spark, d):
    return _plays(spark, d).select("event_id", X.normalized_play(F.col("raw")).alias("text"))


@query(
    f"""WITH {_PLAYS}, n AS (SELECT event_id, type, lower({_NORMAL}) AS t FROM plays)
SELECT event_id, CASE WHEN contains(t, 'free throw') THEN CASE WHEN contains(t, ' makes ') THEN 'FT MADE' ELSE 'FT MISSED' END WHEN contains(t, ' makes ') THEN 'MADE +' || CASE WHEN contains(t, 'three point') THEN 3 ELSE 2 END
WHEN contains(t, ' misses ') THEN CASE WHEN contains(t, 'three point') THEN 'MISSED 3' ELSE 'MISSED 2' END WHEN contains(t, 'turnover') THEN 'TURNOVER' WHEN type LIKE '%Rebound' THEN 'DEF REB' ELSE upper(type) END AS style FROM n"""
)
def event_style(spark, d):
    return _plays(spark, d).select("event_id", X.event_style(F.col("type"), X.normalized_play(F.col("raw")), F.lit(None).cast("int")).alias("style"))


@query(
    f"""WITH {_PLAYS}, n AS (SELECT event_id, user_id, {_NORMAL} AS t, type FROM plays JOIN events USING (event_id)),
l AS (SELECT *, CASE WHEN contains(lower(t), 'free throw') THEN 'free_throws' WHEN contains(lower(type), 'turnover') OR contains(lower(t), 'turnover') THEN 'turnover'
 WHEN contains(t, ' makes ') OR contains(t, ' misses ') THEN CASE WHEN contains(t, ' makes ') THEN 'made_' ELSE 'missed_' END || CASE WHEN contains(t, 'three point') THEN '3' ELSE '2' END END AS label FROM n)
SELECT user_id, arg_max(label, event_id) FILTER (WHERE label IS NOT NULL) AS outcome, CAST(coalesce(sum(CASE WHEN contains(t, ' makes ') THEN 2 END), 0) AS BIGINT) AS points FROM l GROUP BY user_id"""
)
def possession_outcome(spark, d):
    text = X.normalized_play(F.col("raw"))
    e = _plays(spark, d).select("user_id", F.col("event_id").alias("seq"), F.lit("A").alias("team"), "type", text.alias("text"), X.is_made(text).alias("scoring"), F.lit(2).alias("score_value"), F.lit(None).cast("string").alias("offense"))
    return V.outcome(e, ["user_id"])


@query(
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 20) || ':' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') WHEN 1 THEN (p_size % 60) || '.' || (p_partkey % 10) WHEN 2 THEN CAST(p_partkey % 1000 AS VARCHAR) ELSE 'x' END AS s FROM part)
SELECT p_partkey, s, CASE WHEN regexp_full_match(s, '\\d{1,2}:\\d{2}') THEN CAST(split_part(s, ':', 1) AS DOUBLE) * 60 + CAST(split_part(s, ':', 2) AS DOUBLE) WHEN regexp_full_match(s, '\\d{1,2}\\.\\d') THEN CAST(s AS DOUBLE) END AS seconds,
CASE WHEN length(regexp_replace(s, '\\D', '', 'g')) BETWEEN 1 AND 3 THEN CAST(regexp_replace(s, '\\D', '', 'g') AS INT) END AS score, CASE WHEN length(regexp_replace(s, '\\D', '', 'g')) BETWEEN 1 AND 2 THEN CAST(CAST(regexp_replace(s, '\\D', '', 'g') AS INT) AS VARCHAR) END AS jersey FROM c"""
)
def clock_parse(spark, d):
    return _readings(spark, d).select("p_partkey", "s", X.clock_seconds(F.col("s")).alias("seconds"), X.parsed_score(F.col("s")).alias("score"), X.jersey_number(F.col("s")).alias("jersey"))


def _readings(spark, d):
    p, k, s = table(spark, d, "part"), F.col("p_partkey") % 4, lambda c: c.cast("string")
    text = F.when(k == 0, F.concat(s(F.col("p_partkey") % 20), F.lit(":"), F.lpad(s(F.col("p_size") % 60), 2, "0"))).when(k == 1, F.concat(s(F.col("p_size") % 60), F.lit("."), s(F.col("p_partkey") % 10))).when(k == 2, s(F.col("p_partkey") % 1000)).otherwise("x")
    return p.select("p_partkey", text.alias("s"))


@query(
    """WITH c AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 20) || ':' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') WHEN 1 THEN (p_size % 60) || '.' || (p_partkey % 10) WHEN 2 THEN CAST(p_partkey % 1000 AS VARCHAR) ELSE 'x' END AS s FROM part),
g AS (SELECT *, regexp_replace(s, '\\D', '', 'g') AS dg, regexp_full_match(s, '\\d{1,2}:\\d{2}') AS colon, regexp_full_match(s, '\\d{1,2}\\.\\d') AS point FROM c),
l AS (SELECT p_partkey, s, colon, list_filter([
 CASE WHEN colon AND CAST(split_part(s, ':', 1) AS INT) <= 20 AND CAST(split_part(s, ':', 2) AS INT) < 60 THEN {'v': CAST(split_part(s, ':', 1) AS DOUBLE) * 60 + CAST(split_part(s, ':', 2) AS DOUBLE), 't': CAST(split_part(s, ':', 1) AS INT) || ':' || split_part(s, ':', 2)} END,
 CASE WHEN point AND CAST(s AS DOUBLE) < 60 THEN {'v': CAST(s AS DOUBLE), 't': printf('%.1f', CAST(s AS DOUBLE))} END,
 CASE WHEN NOT colon AND NOT point AND length(dg) = 4 AND CAST(dg[1:2] AS INT) <= 20 AND CAST(dg[3:4] AS INT) < 60 THEN {'v': CAST(dg[1:2] AS DOUBLE) * 60 + CAST(dg[3:4] AS DOUBLE), 't': CAST(dg[1:2] AS INT) || ':' || dg[3:4]} END,
 CASE WHEN NOT colon AND length(dg) = 3 AND CAST(dg[2:3] AS INT) < 60 THEN {'v': CAST(dg[1:1] AS DOUBLE) * 60 + CAST(dg[2:3] AS DOUBLE), 't': dg[1:1] || ':' || dg[2:3]} END,
 CASE WHEN NOT colon AND NOT point AND length(dg) BETWEEN 2 AND 3 AND CAST(dg AS INT) / 10.0 < 60 THEN {'v': CAST(dg AS INT) / 10.0, 't': printf('%.1f', CAST(dg AS INT) / 10.0)} END], lambda x: x IS NOT NULL) AS c FROM g)
SELECT p_partkey, s, [CAST(x.v AS DOUBLE) FOR x IN c] AS seconds, [x.t FOR x IN c] AS texts, CAST(CASE WHEN colon THEN 0 ELSE 1 END AS INT) AS picked FROM l"""
)
def clock_candidates(spark, d):
    c = X.clock_candidates(F.col("s"))
    return _readings(spark, d).select("p_partkey", "s", F.transform(c, lambda x: x["value"]).alias("seconds"), F.transform(c, lambda x: x["text"]).alias("texts"), X.picked_clock(F.array("s", F.lit("7:04"), F.lit("31.1"))).alias("picked"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def json_prop_roundtrip(spark, d):
    parsed = S.json_parsed(table(spark, d, "events"), "props", "k int")
    parsed = S.json_parsed(S.json_written(parsed, "props"), "props", "k int")
    return parsed.groupBy("event_type", F.col("props.k").alias("k")).agg(F.count("*").alias("n"))


_BIN = f"CASE {' '.join(f'WHEN s >= {lo} AND s < {30 if hi is None else min(hi, 30)} THEN {k}' for k, (lo, hi) in enumerate(spec.BINS))} END"
_BINNED = ZONED + f""", b AS (SELECT *, {_BIN} AS bin FROM (SELECT *, (t - floor(t / 86400.0) * 86400.0) / 2880.0 AS s, floor(t / 86400.0) * 86400.0 + (t - floor(t / 86400.0) * 86400.0) / 2880.0 AS moment FROM z)),
frames AS (SELECT game, bin, count(DISTINCT moment) AS f FROM b WHERE bin IS NOT NULL GROUP BY ALL), cells AS (SELECT game, bin * {spec.ZONES} + zone AS i, count(*) AS n, bin FROM b WHERE bin IS NOT NULL GROUP BY ALL),
occ AS (SELECT g.game, list(coalesce(round(c.n / frames.f, 6), 0.0) ORDER BY r.i) AS occupancy FROM (SELECT DISTINCT game FROM v) g CROSS JOIN range({len(spec.BINS) * spec.ZONES}) r(i) LEFT JOIN cells c ON c.game = g.game AND c.i = r.i LEFT JOIN frames ON frames.game = c.game AND frames.bin = c.bin GROUP BY g.game)"""
_HANDLED = """hz AS (SELECT game, bin, zone, count(*) AS n FROM b WHERE bin IS NOT NULL AND {held} GROUP BY ALL), hk AS (SELECT *, row_number() OVER (PARTITION BY game, bin ORDER BY n DESC, zone) AS r FROM hz),
hand AS (SELECT g.game, list(CAST(coalesce(zone, -1) AS INT) ORDER BY i) AS handler FROM (SELECT DISTINCT game FROM v WHERE {held}) g CROSS JOIN range(5) q(i) LEFT JOIN hk ON hk.game = g.game AND hk.bin = i AND r = 1 GROUP BY g.game)"""


def _anchored(spark, d):
    """A day is 30 s from its beginning, the set-up."""
    anchor = F.floor(F.col("t") / 86400.0) * 86400.0
    return zoned(spark, d).withColumn("anchor", anchor).withColumn("t_end", F.col("anchor") + 30.0).withColumn("t", F.col("anchor") + (F.col("t") - F.col("anchor")) / 2880.0)


@query(f"WITH {_BINNED} SELECT game, occupancy FROM occ")
def time_bin_occupancy(spark, d):
    return FE.occupancy_by_bin(_anchored(spark, d), "game").select("game", F.transform("occupancy", lambda x: F.round(x, 6)).alias("occupancy"))


@query(f"WITH {_BINNED}, {_HANDLED.format(held='true')} SELECT game, handler FROM hand")
def handler_modal_zone(spark, d):
    return FE.handler_zones(_anchored(spark, d), "game")


@query(
    f"""WITH {_BINNED}, {_HANDLED.format(held='event_id % 4 = 0')} SELECT occ.game, list_concat(list_concat(occupancy, [round(CASE WHEN z < 0 THEN -1.0 ELSE z / {spec.ZONES}.0 END, 6) FOR z IN coalesce(handler, [-1, -1, -1, -1, -1])]), [0.0, 1.0, 0.0]) AS vector FROM occ LEFT JOIN hand ON occ.game = hand.game"""
)
def feature_vectors(spark, d):
    v = _anchored(spark, d)
    occ, hand = FE.occupancy_by_bin(v, "game"), FE.handler_zones(v.filter("event_id % 4 = 0"), "game")
    vector = FE.cluster_vector(F.col("occupancy"), F.coalesce("handler", F.array_repeat(F.lit(-1), 5)), F.lit("dead"))
    return occ.join(hand, "game", "left").select("game", F.transform(vector, lambda x: F.round(x, 6)).alias("vector"))


@query(
    """WITH p AS (SELECT l_orderkey % 50 AS game, l_linenumber AS period, count(*) AS n, round(avg(CASE WHEN l_returnflag <> 'A' THEN 1.0 ELSE 0.0 END), 3) AS rate, count_if(l_returnflag = 'N') AS agree FROM lineitem GROUP BY ALL)
SELECT game, round(sum(n * rate) / sum(n), 3) AS trust, CAST(count(*) AS BIGINT) AS periods, sum(agree) / sum(n) >= .5 AS agrees, round(sum(n * rate) / sum(n), 3) >= .7 AS trusted FROM p GROUP BY game"""
)
def trust_rates_weighted(spark, d):
    l = table(spark, d, "lineitem").withColumn("clock", F.when(F.col("l_returnflag") != "A", 1))  # noqa: E741
    p = l.groupBy((F.col("l_orderkey") % 50).alias("game"), F.col("l_linenumber").alias("period")).agg(F.count("*").alias("n"), V.null_rate("clock").alias("rate"), F.count_if(F.col("l_returnflag") == "N").alias("agree"))
    trust = F.round(F.sum(F.col("n") * F.col("rate")) / F.sum("n"), 3)
    return p.groupBy("game").agg(trust.alias("trust"), F.count("*").alias("periods"), (F.sum("agree") / F.sum("n") >= 0.5).alias("agrees"), (trust >= 0.7).alias("trusted"))


@query(
    """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INT) AS level, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS ppp, count(*) < 8 AS thin FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())"""
)
def ppp_rollup(spark, d):
    return V.results_rollup(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query(f"WITH {COURT}, s AS (SELECT game, t_ms, x, y, CASE WHEN t > lag(t) OVER o THEN sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) / (t - lag(t) OVER o) END AS sp FROM v WINDOW o AS (PARTITION BY game ORDER BY t)) SELECT game, coalesce(round(median(sp), 1), 0) AS speed, coalesce(round(median(sp), 1), 0) > 15 AS erratic FROM s GROUP BY game")
def median_speed(spark, d):
    return W.median_speed(court(spark, d), key=["game"])


@query(f"WITH {COURT}, g AS (SELECT *, sum(CASE WHEN value > 60 THEN 0 ELSE 1 END) OVER (PARTITION BY game ORDER BY t_ms) AS grp FROM v) SELECT game, CAST(count(*) AS BIGINT) AS n, min(t_ms) AS run FROM g WHERE value > 60 GROUP BY game, grp")
def valid_run_lengths(spark, d):
    return W.runs_of_true(court(spark, d), key="game", order="t_ms", flag=F.col("value") > 60)


@query(f"WITH {COURT} SELECT event_id, CAST((game % 4) * 1000000 + sum(CASE WHEN value > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY t_ms, event_id ROWS UNBOUNDED PRECEDING) * 1000 + event_id % 50 AS BIGINT) AS epoch_id FROM v")
def shot_epoch_ids(spark, d):
    v = court(spark, d).withColumn("cut", F.col("value") > 200).withColumn("track", F.col("event_id") % 50).withColumn("ord", F.struct("t_ms", "event_id"))
    return W.epoch_ids(v, key="game", order="ord", cut="cut", track="track", chunk=F.col("game") % 4).select("event_id", "epoch_id")


@query(
    f"""WITH {COURT} SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS trail, round(sum(value) OVER w, 6) AS trail_value FROM v WINDOW w AS (PARTITION BY game ORDER BY t_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)"""
)
def trail_range_frame(spark, d):
    rows = W.trailing(court(spark, d), key="game", order="t_ms", width=86400000, trail=F.count("*"), trail_value=F.sum("value"))
    return rows.select("event_id", "trail", F.round("trail_value", 6).alias("trail_value"))


@query(f"WITH {COURT} SELECT event_id, game, coalesce(lead(event_type) OVER o = 'purchase' AND lead(t_ms) OVER o - t_ms < 3600000, false) AS stolen FROM v WINDOW o AS (PARTITION BY game ORDER BY t_ms, event_id)")
def next_event_lookahead(spark, d):
    rows = W.followed_by(court(spark, d), key="game", order=["t_ms", "event_id"], what=F.col("event_type") == "purchase", t="t_ms", within=3600000, out="stolen")
    return rows.select("event_id", "game", "stolen")


@query(
    """WITH e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), u AS (SELECT label, i, avg(v[i]) AS c FROM e, range(1, 65) r(i) GROUP BY ALL), cent AS (SELECT label, list(c ORDER BY i) AS c FROM u GROUP BY label),
k AS (SELECT e.label, vec_id, round(list_distance(v, c), 6) AS distance, CAST(row_number() OVER (PARTITION BY e.label ORDER BY round(list_distance(v, c), 6), vec_id) AS INT) AS rank FROM e JOIN cent ON e.label = cent.label) SELECT * FROM k WHERE rank <= 9"""
)
def top_members_per_cluster(spark, d):
    from .operators.clusters import centroids, nearest_members, squared_distance

    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    distance = F.round(F.sqrt(squared_distance(F.col("v"), F.col("centroid"))), 6)
    rows = e.join(centroids(e, "label", "v", 64), "label").select("label", "vec_id", distance.alias("distance"))
    return nearest_members(rows, cluster="label", id_="vec_id", distance="distance", n=9)


@query(
    """WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings) SELECT vec_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 5) AS za, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 5) AS zb FROM e"""
)
def zscore_population(spark, d):
    from .operators.clusters import standardized

    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    return standardized(e, "v", 2).select("vec_id", F.round(F.col("v")[0], 5).alias("za"), F.round(F.col("v")[1], 5).alias("zb"))


@query(
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
i AS (SELECT sum(n * (n - 1) / 2) AS x FROM c), p AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM c GROUP BY b)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS x FROM c)
SELECT round((i.x - p.x * q.x / t.x) / ((p.x + q.x) / 2 - p.x * q.x / t.x), 6) AS ari FROM i, p, q, t"""
)
def adjusted_rand(spark, d):
    from .operators.clusters import adjusted_rand_index

    return adjusted_rand_index(table(spark, d, "labels"), "quality", "toxic")


@query(
    """WITH q AS (SELECT o_orderpriority, count(*) AS n, 500.0 * count(*) / (SELECT count(*) FROM orders) AS quota FROM orders GROUP BY 1),
t AS (SELECT *, floor(quota) + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, o_orderpriority) <= least(500, (SELECT count(*) FROM orders)) - sum(floor(quota)) OVER () THEN 1 ELSE 0 END AS take FROM q),
k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM orders) SELECT o_orderkey, k.o_orderpriority FROM k JOIN t ON k.o_orderpriority = t.o_orderpriority WHERE r <= take"""
)
def stratified_sample(spark, d):
    return V.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 500)


_CHAIN = "chain AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 7 WHEN 0 THEN 'set ' || c_nationkey WHEN 1 THEN 'discard' ELSE 'merge:' || (c_custkey // 2) END AS label FROM customer)"


@query(
    f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT id, label, 0 AS depth FROM chain UNION ALL SELECT r.id, c.label, depth + 1 FROM r JOIN chain c ON r.label LIKE 'merge:%' AND c.id = substr(r.label, 7) WHERE depth < 15)
SELECT chain.id, max(CASE WHEN r.label NOT LIKE 'merge:%' AND r.label NOT IN ('discard', '') THEN r.label END) AS name FROM chain LEFT JOIN r ON chain.id = r.id GROUP BY chain.id"""
)
def merge_chain_resolve(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 7
    label = F.when(k == 0, F.concat(F.lit("set "), F.col("c_nationkey").cast("string"))).when(k == 1, "discard").otherwise(F.concat(F.lit("merge:"), F.floor(F.col("c_custkey") / 2).cast("string")))
    return W.resolved_labels(c.select(F.col("c_custkey").cast("string").alias("id"), label.alias("label")), 15)


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey AND c_acctbal > 9000), r(node) AS (SELECT 1 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r"""
)
def force_closure(spark, d):
    edges = table(spark, d, "customer").filter("c_acctbal > 9000").join(table(spark, d, "supplier"), F.expr("c_custkey % 100 = s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    return W.closure(edges, spark.range(1).select(F.lit(1).alias("node")))


_SEEN = 1704240000000  # a moment within 0.05 s of which a third of all rows is put


@query(
    f"""WITH {ZONED}, f AS (SELECT game, event_type AS name, arg_min(zone, (t_ms % 100, zone)) AS zone FROM z WHERE event_id % 3 = 0 AND t_ms % 100 < 51 GROUP BY ALL)
SELECT g.game, flatten(list([CAST(i = coalesce(f.zone, {spec.ZONES}) AS DOUBLE) FOR i IN range({spec.ZONES + 1})] ORDER BY n.name)) AS snapshot
FROM (SELECT DISTINCT game FROM v) g CROSS JOIN (SELECT DISTINCT event_type AS name FROM v) n LEFT JOIN f ON f.game = g.game AND f.name = n.name GROUP BY g.game"""
)
def snapshot_one_hot(spark, d):
    v = court(spark, d).withColumn("name", F.col("event_type"))
    near = F.when(F.col("event_id") % 3 == 0, (F.col("t_ms") % 100) / 1000.0 + _SEEN)  # the others are seen at another time
    points = v.select("game", "name", F.coalesce(near, F.col("t") - 1e6).alias("t"), "x", "y", F.lit(float(_SEEN)).alias("setup"))
    return FE.identity_snapshot(points, v.select("name").distinct(), "game")


