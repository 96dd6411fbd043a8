"""Queries of the state machines, models, records and streams, over rows that Spark derives from the tables.

Most have no SQL: they are tested against golden values and brute force. Reads and plays come from events: a user is a
game, a month its 30 days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import catalog_game  # noqa: F401  adds its queries
from .catalog import _GREEDY, _SEGMENTS, COURT, court, query, table
from .operators import clusters as K
from .operators import display as D
from .operators import features as FE
from .operators import joins as J
from .operators import reports as R
from .operators import states as S
from .operators import tracks as TR
from .operators import votes as V
from .operators import windows as W
from .plans.session import checkpointed


@query()
def segments_debounced(spark, d):
    v = court(spark, d)
    settled = S.debounced(v, key="game", order=["t", "event_id"], label="half", least=3)
    return W.segments(settled, key="game", t="t", label="half", max_gap=43200, merge_gap=172800, min_duration=3600, tie="event_id").select("game", "segment", "half", "t_lo", "t_hi", "n")


@query()
def stitch_tracks(spark, d):
    v = court(spark, d).withColumn("frame", F.floor(F.col("t_ms") / 3600000))
    v = v.groupBy("game", (F.floor(F.col("t_ms") / 86400000) * 4 + F.col("event_id") % 4).alias("track"), "frame").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("cluster").alias("cluster"))
    return TR.stitch_tracks(v, keys=["game"], fps=10.0)


@query()
def path_clean(spark, d):
    w = Window.partitionBy("game").orderBy("t_ms", "event_id")
    v = court(spark, d).withColumn("frame", F.row_number().over(w))
    gone = F.col("event_id") % 11 == 0
    return TR.clean_paths(v.select("game", "frame", F.when(~gone, F.col("x")).alias("x"), F.when(~gone, F.col("y")).alias("y")), keys=["game"]).select("game", "frame", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_FILL = f"""WITH {COURT}, r AS (SELECT game, row_number() OVER (PARTITION BY game ORDER BY t_ms, event_id) AS frame, CASE WHEN event_id % 11 = 0 THEN NULL ELSE x END AS x FROM v),
k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY game ORDER BY frame) AS a, min(CASE WHEN x IS NOT NULL THEN frame END) OVER (PARTITION BY game ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM r)
SELECT k.game, CAST(k.frame AS INT) AS frame, round(CASE WHEN k.x IS NOT NULL THEN k.x WHEN ra.x IS NULL THEN rb.x WHEN rb.x IS NULL THEN ra.x ELSE ra.x + (rb.x - ra.x) * (k.frame - a) / (b - a) END, 6) AS filled
FROM k LEFT JOIN r ra ON ra.game = k.game AND ra.frame = a LEFT JOIN r rb ON rb.game = k.game AND rb.frame = b"""


@query(_FILL)
def path_fill(spark, d):
    w = Window.partitionBy("game").orderBy("t_ms", "event_id")
    v = court(spark, d).select("game", F.row_number().over(w).alias("frame"), F.when(F.col("event_id") % 11 != 0, F.col("x")).alias("x"))
    return W.filled_and_smoothed(v, key=["game"], order="frame", value="x").select("game", "frame", F.round("filled", 6).alias("filled"))


def _five_a_side(spark, d) -> DataFrame:
    """Every event in a frame of five a side at most: those of a day and side, five after five."""
    w = Window.partitionBy("game", "day", "cluster").orderBy("event_id")
    v = court(spark, d).withColumn("day", F.floor(F.col("t_ms") / 86400000).cast("int")).withColumn("n", F.row_number().over(w) - 1)
    frame = (F.col("day") * 1000 + F.floor(F.col("n") / 5)).cast("int")
    return v.select("game", frame.alias("frame"), F.when(F.col("cluster") == 0, "off").otherwise("def").alias("side"), F.col("event_id").alias("track"), (F.col("n") % 5 + 1).cast("long").alias("place"), "x", "y")


@query()
def matchup_assignment(spark, d):
    return TR.matchups(_five_a_side(spark, d), keys=["game", "frame"], least=1).select("game", "frame", "off", "def", F.round("distance", 6).alias("distance"))


@query()
def defence_features(spark, d):
    p = _five_a_side(spark, d).select("game", F.col("frame").cast("double").alias("t"), "side", F.col("place").alias("track"), "x", "y")
    pairs = TR.matchups(p, keys=["game", "t"], least=1)
    pairs = checkpointed(pairs)  # read by four aggregates
    m = FE.defence_measures(pairs, p, key="game", least=5)
    return m.select("game", "frames", *[F.round(c, 5).alias(c) for c in ("stability", "follow", "spread", "gap", "paint")])


@query(
    f"""WITH RECURSIVE {COURT}, tr AS (SELECT game, event_id % 12 AS track, min(CASE WHEN cluster = 0 THEN 'A' ELSE 'B' END) AS team, min(CAST(event_id % 4 AS VARCHAR)) AS jersey, count(*) AS votes, min(t) AS t_lo, max(t) AS t_hi FROM v GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY votes DESC, track) AS n FROM tr),
k(game, i, kept, track, keeps) AS (SELECT DISTINCT game, 0, CAST([] AS STRUCT(team VARCHAR, jersey VARCHAR, t_lo DOUBLE, t_hi DOUBLE)[]), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN) FROM tr
UNION ALL SELECT game, i, CASE WHEN clash THEN kept ELSE list_append(kept, one) END, track, NOT clash FROM (
  SELECT k.game, i + 1 AS i, kept, r.track, {{'team': r.team, 'jersey': r.jersey, 't_lo': r.t_lo, 't_hi': r.t_hi}} AS one,
  len(list_filter(kept, lambda q: q.team = r.team AND q.jersey = r.jersey AND q.t_lo <= r.t_hi AND r.t_lo <= q.t_hi)) > 0 AS clash FROM k JOIN r ON r.game = k.game AND r.n = k.i + 1))
SELECT game, track, keeps FROM k WHERE track IS NOT NULL"""
)
def jersey_conflicts(spark, d):
    v = court(spark, d)
    tracks = v.groupBy("game", (F.col("event_id") % 12).alias("track")).agg(F.min(F.when(F.col("cluster") == 0, "A").otherwise("B")).alias("team"), F.min((F.col("event_id") % 4).cast("string")).alias("jersey"), F.count("*").alias("votes"), F.min("t").alias("t_lo"), F.max("t").alias("t_hi"))
    return TR.resolve_conflicts(tracks, keys=["game"])


@query()
def homography_fits(spark, d):
    """A camera for each user, its 33 landmarks seen through it, one of them misplaced."""
    from .functions import court as C
    from .plans import spec

    users = table(spark, d, "events").select(F.col("user_id").alias("game")).distinct()
    g = F.col("game") % 40
    h = F.array(12.0 + g / 10, 0.3 + g / 100, 40.0 + g, F.lit(-0.2), 9.0 - g / 20, 30.0 + g, 0.0008 + g / 100000, F.lit(0.0015), F.lit(1.0))
    points = []
    for k, (x, y) in enumerate(spec.landmarks()):
        px, py = C.project(F.col("h"), F.lit(x), F.lit(y))
        points.append(F.array(px + (60.0 if k == 7 else 0.0), py, F.lit(0.9 if k % 5 else 0.4)))
    fitted = users.withColumn("h", h).select("game", "h", F.array(*points).alias("keypoints")).withColumn("fit", TR.homography(F.col("keypoints")))
    bx, by = C.project(F.col("fit.h"), *C.project(F.col("h"), F.lit(20.0), F.lit(30.0)))
    return fitted.select("game", F.col("fit.n").alias("n"), F.round(bx, 3).alias("x"), F.round(by, 3).alias("y"), (F.col("fit.error") < 0.01).alias("exact"))


@query(
    """WITH e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS c, b.label AS c2, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT vec_id, min(CASE WHEN c = c2 THEN d END) AS a, min(CASE WHEN c <> c2 THEN d END) AS b FROM d GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s"""
)
def silhouette_euclid(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return K.silhouettes(e, "vec_id", "label", "v").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query(
    """WITH s AS (SELECT p_size AS k, avg(p_retailprice) AS mean, stddev_pop(p_retailprice) / sqrt(count(*)) AS se FROM part GROUP BY p_size), b AS (SELECT mean, se FROM s ORDER BY mean DESC, k LIMIT 1) SELECT min(k) AS k FROM s, b WHERE s.mean >= b.mean - b.se"""
)
def one_se_choice(spark, d):
    s = table(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg(F.avg("p_retailprice").alias("mean"), (F.stddev_pop("p_retailprice") / F.sqrt(F.count("*"))).alias("se"))
    return K.chosen_k(s)


@query()
def kmeans_sets(spark, d):
    """The whole sweep, ten starts for each k, and the stability of the chosen one."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows, model = K.fit_clusters(e, id_="vec_id", vector="v", dims=64)
    return rows.select("vec_id", "cluster", F.round("distance", 4).alias("distance"), F.lit(model.k).alias("k"), F.round(F.lit(model.stability), 4).alias("stability"))


@query(
    """WITH e AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), u AS (SELECT label, i, avg(v[i]) AS c FROM e, range(1, 65) r(i) GROUP BY ALL), cent AS (SELECT label, list(c ORDER BY i) AS c FROM u GROUP BY label),
k AS (SELECT vec_id, cent.label AS cluster, list_distance(v, c) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cent.label) AS r FROM e CROSS JOIN cent) SELECT vec_id, cluster, round(dist, 6) AS distance FROM k WHERE r = 1"""
)
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    centres = K.centroids(e, "label", "v", 64).select(F.col("label").alias("cluster"), "centroid")
    return K.assigned(e, centres, id_="vec_id", vector="v").withColumn("distance", F.round("distance", 6))


@query()
def supervised_team(spark, d):
    e = table(spark, d, "embeddings").withColumn("crop", F.when(F.col("label") < 2, F.col("label")).otherwise(-1))
    return K.supervised_team(e, vector="embedding", label="crop").select("vec_id", "team")


_ACCEPT = """WITH c AS (SELECT o_orderkey % 40 AS game, count(DISTINCT o_orderpriority) AS detected, count(*) AS intervals, count_if(o_orderstatus <> 'P') AS located, count_if(o_orderstatus = 'F') AS agree, count_if(o_orderstatus = 'P') AS disagree, round(avg(CASE WHEN o_totalprice > 30000 THEN 1.0 ELSE 0.0 END), 3) AS trust FROM orders GROUP BY 1)
SELECT game, list_filter([CASE WHEN detected <> 5 THEN 'periods' END, CASE WHEN NOT located / intervals >= .85 THEN 'located' END, CASE WHEN NOT coalesce(agree / nullif(agree + disagree, 0) >= .85, false) THEN 'agreement' END, CASE WHEN trust < .7 THEN 'trust' END], lambda x: x IS NOT NULL) AS flags FROM c"""


@query(_ACCEPT)
def acceptance_gates(spark, d):
    o = table(spark, d, "orders").withColumn("read", F.when(F.col("o_totalprice") > 30000, 1))
    c = o.groupBy((F.col("o_orderkey") % 40).alias("game")).agg(F.lit(5).alias("expected_periods"), F.countDistinct("o_orderpriority").alias("detected_periods"), F.count("*").alias("intervals"), F.count_if(F.col("o_orderstatus") != "P").alias("located"), F.count_if(F.col("o_orderstatus") == "F").alias("agree"), F.count_if(F.col("o_orderstatus") == "P").alias("disagree"), V.null_rate("read").alias("trust"))
    return R.acceptance(c).select("game", "flags")


@query(
    """SELECT o_custkey AS game, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'P') AS cost, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS attempts FROM orders GROUP BY o_custkey"""
)
def status_upsert(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("game"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("cost"))
    return R.merged_status(o.filter(F.col("at.o_orderkey") % 2 == 0), o.filter(F.col("at.o_orderkey") % 2 == 1))


@query(
    """SELECT c_custkey, c_name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY try_cast(regexp_replace(c_name, '\\D', '', 'g') AS INT) % 97 NULLS LAST, c_name) AS INT) AS rank FROM customer"""
)
def jersey_order(spark, d):
    c = table(spark, d, "customer").withColumn("jersey", F.regexp_replace("c_name", r"\D", "").try_cast("int") % 97)
    return D.roster_order(c, team="c_nationkey", jersey="jersey", name="c_name").select("c_custkey", "c_name", "rank")


@query(
    """WITH p AS (SELECT event_id AS point_id, user_id AS game, ((event_id * 37) % 940) / 10.0::DOUBLE AS x, ((event_id * 53) % 500) / 10.0::DOUBLE AS y FROM events),
b AS (SELECT user_id AS game, event_id AS box_id, ((event_id * 91) % 800) / 10.0::DOUBLE AS x1, ((event_id * 17) % 400) / 10.0::DOUBLE AS y1, ((event_id * 91) % 800) / 10.0::DOUBLE + 2 + event_id % 13 AS x2, ((event_id * 17) % 400) / 10.0::DOUBLE + 2 + event_id % 7 AS y2 FROM events WHERE event_id % 5 = 0),
j AS (SELECT p.game, point_id, box_id, row_number() OVER (PARTITION BY point_id ORDER BY (x2 - x1) * (y2 - y1), box_id) AS r FROM p JOIN b ON p.game = b.game AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)
SELECT p.game, p.point_id, box_id FROM p LEFT JOIN j ON p.point_id = j.point_id AND r = 1"""
)
def smallest_box(spark, d):
    v = court(spark, d)
    x1, y1 = (F.col("event_id") * 91) % 800 / 10.0, (F.col("event_id") * 17) % 400 / 10.0
    boxes = v.filter("event_id % 5 = 0").select("game", F.col("event_id").alias("box_id"), F.array(x1, y1, x1 + 2 + F.col("event_id") % 13, y1 + 2 + F.col("event_id") % 7).alias("bbox"))
    return J.smallest_container(v.select("game", F.col("event_id").alias("point_id"), "x", "y"), boxes, keys=["game"], cell=10.0).select("game", "point_id", "box_id")


@query(
    f"""WITH {COURT}, b AS (SELECT game, cluster, avg(value) AS brightness, count_if(event_id % 3 = 0) AS home_votes, count_if(event_id % 3 = 1) AS away_votes FROM v GROUP BY ALL),
s AS (SELECT game, max(home_votes) FILTER (WHERE cluster = 0) + max(away_votes) FILTER (WHERE cluster = 1) AS a, max(home_votes) FILTER (WHERE cluster = 1) + max(away_votes) FILTER (WHERE cluster = 0) AS b, max(brightness) FILTER (WHERE cluster = 0) AS b0, max(brightness) FILTER (WHERE cluster = 1) AS b1 FROM b GROUP BY game)
SELECT game, CASE WHEN abs(a - b) >= 3 THEN CASE WHEN a > b THEN 0 ELSE 1 END WHEN b0 >= b1 THEN 0 ELSE 1 END AS home_cluster, CASE WHEN abs(a - b) >= 3 THEN 'numbers' ELSE 'brightness' END AS how FROM s"""
)
def cluster_naming(spark, d):
    c = court(spark, d).groupBy("game", "cluster").agg(F.avg("value").alias("brightness"), F.count_if(F.col("event_id") % 3 == 0).alias("home_votes"), F.count_if(F.col("event_id") % 3 == 1).alias("away_votes"))
    return V.team_of_cluster(c)


@query(
    f"""WITH {_SEGMENTS}, c AS (SELECT s.game, s.segment, s.half, s.t_lo, s.t_hi, count(v.t) FILTER (WHERE v.cluster = 1) AS n1, count(v.t) FILTER (WHERE v.cluster = 0) AS n0 FROM segs s LEFT JOIN v ON v.game = s.game AND v.t BETWEEN s.t_lo AND s.t_hi GROUP BY ALL),
nb AS (SELECT a.game, a.segment, sum(CASE WHEN o.half = 1 THEN o.n1 ELSE o.n0 END) AS r1, sum(CASE WHEN o.half = 1 THEN o.n0 ELSE o.n1 END) AS r0 FROM c a JOIN c o ON o.game = a.game AND o.t_lo <= a.t_hi + 86400 AND o.t_hi >= a.t_lo - 86400 GROUP BY ALL),
wh AS (SELECT game, CASE WHEN count_if((half = 1 AND cluster = 0) OR (half = -1 AND cluster = 1)) > count_if((half = 1 AND cluster = 1) OR (half = -1 AND cluster = 0)) THEN 0 ELSE 1 END AS w FROM v GROUP BY game)
SELECT c.game, c.segment, CAST(CASE WHEN n1 + n0 >= 3 AND n1 <> n0 THEN CASE WHEN n1 > n0 THEN 1 ELSE 0 END WHEN r1 + r0 >= 3 THEN CASE WHEN c.half = 1 THEN CASE WHEN r0 > r1 THEN 0 ELSE 1 END ELSE CASE WHEN r0 > r1 THEN 1 ELSE 0 END END
 ELSE CASE WHEN c.half = 1 THEN w ELSE 1 - w END END AS INT) AS offense FROM c JOIN nb ON c.game = nb.game AND c.segment = nb.segment JOIN wh ON wh.game = c.game"""
)
def segment_offense(spark, d):
    segs = W.segments(court(spark, d), key="game", t="t", label="half", max_gap=43200, merge_gap=172800, min_duration=3600, tie="event_id")
    return V.segment_offense(segs.select("game", "segment", "half", "t_lo", "t_hi"), court(spark, d).select("game", "t", "half", "cluster"), keys=["game"], min_votes=3, window=86400.0).select("game", "segment", "offense")


@query(f"WITH {COURT} SELECT game, cluster, list(event_type ORDER BY t_ms) AS readings FROM v GROUP BY ALL")
def readings_in_order(spark, d):
    return D.readings_in_order(court(spark, d), ["game", "cluster"], "event_type", "t_ms")


@query(f"WITH {COURT} SELECT DISTINCT game, t_ms // 3600000 * 3600000 AS t_ms FROM v a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM v b WHERE b.game = a.game AND b.event_type = 'click' AND b.t_ms // 3600000 = a.t_ms // 3600000)")
def common_times(spark, d):
    v = court(spark, d).withColumn("t", F.floor(F.col("t_ms") / 3600000) * 3600.0)
    return D.common_times(v.filter("event_type = 'view'"), v.filter("event_type = 'click'"), ["game"])


@query(
    f"""WITH {COURT}, e AS (SELECT game, event_id, t / 3600 AS t FROM v WHERE event_type = 'purchase'), q AS (SELECT DISTINCT game, t / 3600 AS t FROM v)
SELECT q.game, q.t, list(event_id ORDER BY e.t DESC, event_id DESC) AS events FROM q JOIN e ON q.game = e.game AND e.t <= q.t + 1e-6 AND q.t + 1e-6 < e.t + 3 GROUP BY ALL"""
)
def active_events(spark, d):
    v = court(spark, d).withColumn("t", F.col("t") / 3600)
    return D.active_events(v.filter("event_type = 'purchase'").select("game", "event_id", "t"), v.select("game", "t").distinct(), keys=["game"])


@query(
    f"""WITH {COURT}, q AS (SELECT game, t / 3600 AS t, x, y FROM v), g AS (SELECT game, unnest(range(CAST(ceil(min(t) / 6) AS BIGINT), CAST(floor(max(t) / 6) AS BIGINT) + 1)) AS k FROM q GROUP BY game),
j AS (SELECT g.game, k * 6.0::DOUBLE AS t, x, y, row_number() OVER (PARTITION BY g.game, k ORDER BY abs(k * 6.0::DOUBLE - q.t), q.t) AS r FROM g JOIN q ON q.game = g.game AND abs(k * 6.0::DOUBLE - q.t) <= 3.000000001)
SELECT game, t, round(x, 1) AS x, round(y, 1) AS y FROM j WHERE r = 1"""
)
def resampled_tracks(spark, d):
    return D.resampled(court(spark, d).withColumn("t", F.col("t") / 3600).select("game", "t", "x", "y"), keys=["game"], step=6.0, tolerance=3.0)


@query(
    f"""WITH RECURSIVE {COURT}, r AS (SELECT game, t_ms // 86400000 AS day, event_id, x, y, row_number() OVER (PARTITION BY game, t_ms // 86400000 ORDER BY event_id) AS n FROM v),
{_GREEDY.format(apart=1)}, p AS (SELECT game, day, i, q.x AS x, q.y AS y FROM (SELECT game, day, generate_subscripts(kept[:5], 1) AS i, unnest(kept[:5]) AS q FROM last)),
m AS (SELECT p.game, p.day, i, arg_min(CAST(r.event_id % 1000 AS VARCHAR), (sqrt((r.x + 0.2 - p.x) ** 2 + (r.y - p.y) ** 2), CAST(r.event_id % 1000 AS VARCHAR))) AS label FROM p JOIN r ON r.game = p.game AND r.day = p.day AND sqrt((r.x + 0.2 - p.x) ** 2 + (r.y - p.y) ** 2) < 1 GROUP BY ALL)
SELECT p.game, CAST(p.day AS BIGINT) AS day, list(label ORDER BY p.i) AS labels FROM p LEFT JOIN m ON p.game = m.game AND p.day = m.day AND p.i = m.i GROUP BY p.game, p.day"""
)
def labelled_positions(spark, d):
    p = F.sort_array(F.collect_list(F.struct("event_id", "x", "y")))
    f = court(spark, d).groupBy("game", F.floor(F.col("t_ms") / 86400000).alias("day")).agg(p.alias("_p"))
    merged = W.ranked_dedup(F.col("_p"), apart=1.0)
    tracks = F.transform("_p", lambda q: F.struct((q["x"] + 0.2).alias("x"), q["y"].alias("y"), F.lit(None).cast("string").alias("jersey"), q["event_id"].alias("track")))
    return f.select("game", "day", F.transform(D.labelled_positions(merged, tracks), lambda q: q["label"]).alias("labels"))
