"""Sequences: islands, runs, gaps, ranks and the greedy ranked fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import checkpointed


def segments(states: DataFrame, *, key: str, t: str, label: str, max_gap: float, merge_gap: float, min_duration: float, frame: float = 0.0, tie: str | None = None) -> DataFrame:
    """(key, segment, label, t_lo, t_hi, n, duration): runs of one label without gaps.

    A run ends where the label changes or more than max_gap passes. Neighbouring runs of one label at most merge_gap
    apart become one, only then are those shorter than min_duration dropped: a short run of the other label keeps its
    neighbours apart. duration counts the last frame (`frame` long).
    """
    order = Window.partitionBy(key).orderBy(t, *([tie] if tie else []))
    previous, before = F.lag(label).over(order), F.lag(t).over(order)
    rows = states.filter(F.col(label).isNotNull()).withColumn("_new", (before.isNull() | (previous != F.col(label)) | (F.col(t) - before > max_gap)).cast("int"))
    runs = rows.withColumn("_run", F.sum("_new").over(order)).groupBy(key, "_run", label).agg(F.min(t).alias("t_lo"), F.max(t).alias("t_hi"), F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("_run")
    apart = F.coalesce((F.lag(label).over(order) != F.col(label)) | (F.col("t_lo") - F.lag("t_hi").over(order) > merge_gap), F.lit(True))
    merged = runs.withColumn("_new", apart.cast("int")).withColumn("_seg", F.sum("_new").over(order)).groupBy(key, "_seg", label).agg(F.min("t_lo").alias("t_lo"), F.max("t_hi").alias("t_hi"), F.sum("n").alias("n"))
    kept = merged.withColumn("duration", F.col("t_hi") - F.col("t_lo") + frame).filter(F.col("duration") >= min_duration)
    return kept.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("_seg"))).drop("_seg")


def runs_of_true(df: DataFrame, *, key: str, order: str, flag: Column) -> DataFrame:
    """(key, run, n): lengths of the runs of rows in which flag holds."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    rows = rows.withColumn("_g", F.sum((~F.col("_f")).cast("int")).over(w)).filter("_f")
    return rows.groupBy(key, "_g").agg(F.count("*").alias("n"), F.min(order).alias("run")).select(key, "run", "n")


def chunk_runs(df: DataFrame, *, keys: list[str], chunk: str, order: str, flag: Column) -> DataFrame:
    """The state of each chunk of a key (keys, chunk, rows, head, tail, inner): how many rows it has, the lengths of the
    runs of rows with the flag at its start and end (both of all rows, if all have it), and the lengths of those that
    lie within, as an array of (n, times). Chunks are ordered on their own; states of neighbours merge (merged_runs)."""
    part = Window.partitionBy(*keys, chunk)
    w = part.orderBy(order)
    rows = df.select(*keys, chunk, F.coalesce(flag, F.lit(False)).alias("_f"), order)
    rows = rows.withColumn("_i", F.row_number().over(w)).withColumn("_g", F.sum((~F.col("_f")).cast("long")).over(w)).withColumn("_rows", F.count("*").over(part))
    runs = rows.groupBy(*keys, chunk, "_g").agg(F.count_if("_f").alias("n"), F.min(F.when(F.col("_f"), F.col("_i"))).alias("_a"), F.max(F.when(F.col("_f"), F.col("_i"))).alias("_b"), F.first("_rows").alias("_rows"))
    first, last = F.col("_a") == 1, F.col("_b") == F.col("_rows")
    within = runs.filter((F.col("n") > 0) & ~first & ~last).groupBy(*keys, chunk, "n").agg(F.count("*").alias("times")).groupBy(*keys, chunk).agg(F.sort_array(F.collect_list(F.struct("n", "times"))).alias("inner"))
    ends = runs.groupBy(*keys, chunk).agg(F.first("_rows").alias("rows"), F.coalesce(F.max(F.when(first, F.col("n"))), F.lit(0)).alias("head"), F.coalesce(F.max(F.when(last, F.col("n"))), F.lit(0)).alias("tail"))
    return ends.join(within, [*keys, chunk], "left").select(*keys, chunk, "rows", "head", "tail", F.coalesce("inner", F.expr("cast(array() as array<struct<n:bigint,times:bigint>>)")).alias("inner"))


def merged_runs(states: DataFrame, *, keys: list[str], chunk: str) -> DataFrame:
    """(keys, n, times): the histogram of run lengths over all chunks of a key in order, a run that crosses borders
    counting once. Only the states of a key's chunks are folded, a few numbers each."""
    fold = F.aggregate(
        "_s", F.struct(F.lit(0).cast("long").alias("open"), F.expr("cast(array() as array<bigint>)").alias("closed")),
        lambda acc, s: F.when(s["head"] == s["rows"], F.struct((acc["open"] + s["rows"]).alias("open"), acc["closed"].alias("closed"))).otherwise(
            F.struct(s["tail"].alias("open"), F.when(acc["open"] + s["head"] > 0, F.concat(acc["closed"], F.array(acc["open"] + s["head"]))).otherwise(acc["closed"]).alias("closed"))
        ),
    )
    ordered = states.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(chunk, F.col("rows").cast("long").alias("rows"), F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail")))).alias("_s"))
    folded = ordered.select(*keys, fold.alias("_r"))
    whole = F.when(F.col("_r.open") > 0, F.concat("_r.closed", F.array("_r.open"))).otherwise(F.col("_r.closed"))
    crossing = folded.select(*keys, F.explode(whole).alias("n"), F.lit(1).cast("long").alias("times"))
    within = states.select(*keys, F.inline("inner")).select(*keys, F.col("n").cast("long").alias("n"), "times")
    return crossing.unionByName(within).groupBy(*keys, "n").agg(F.sum("times").alias("times"))


def change_points(df: DataFrame, *, key: str, order: list[str], values: list[str], start: list | None = None) -> DataFrame:
    """Rows whose values differ from the row before; the first is compared with `start`, if one is given."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*values)
    before = F.lag(now).over(w)
    if start is not None:
        before = F.coalesce(before, F.struct(*[F.lit(v).alias(c) for v, c in zip(start, values, strict=True)]))
    return df.withColumn("_before", before).filter(~now.eqNullSafe(F.col("_before"))).drop("_before")


def ranked_dedup(points: Column, *, apart: float = 1.0, cap: int | None = 5) -> Column:
    """Greedy choice from array<struct<rank..., x, y>>: in the structs' order a point is kept if it is at least `apart`
    from all kept before, up to `cap`."""
    kept = F.aggregate(
        F.array_sort(points), F.slice(points, 1, 0),
        lambda acc, p: F.when(F.exists(acc, lambda q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]) < apart), acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.slice(kept, 1, cap) if cap else kept


def still_counts_by_radius(frames: DataFrame, *, key: str, t: str, points: str, radii: list[float], back: float = 0.5, tolerance: float = 0.1, half_x: float = 47.0) -> DataFrame:
    """(key, t, visible, stills, frontcourt) for frames whose points are array<struct<x, y>>; stills has a count for each
    radius, all from one look-up of the earlier frame.

    A point is still if any point of the frame nearest to `back` before it (within tolerance) is less than the radius away.
    """
    from .joins import nearest_within

    f = frames.select(key, F.col(t).alias("_t"), F.col(points).alias("_p")).withColumn("_wanted", F.col("_t") - back)
    earlier = f.select(key, F.col("_t").alias("_rt0"), F.col("_p").alias("_old0"))
    j = nearest_within(f, earlier, keys=[key], left_t="_wanted", right_t="_rt0", value="_old0", tolerance=tolerance, left_id=[key, "_t"], out="_old")
    moved = F.transform("_p", lambda p: F.array_min(F.transform("_old", lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))
    j = j.withColumn("_moved", moved)
    stills = F.array(*[_below("_moved", r) for r in radii])
    return j.select(key, F.col("_t").alias(t), F.size("_p").alias("visible"), stills.alias("stills"), F.size(F.filter("_p", lambda p: p["x"] < half_x)).alias("frontcourt"))


def _below(column: str, bound: float) -> Column:
    """How many elements of an array are below a bound; 0 for a null array."""
    return F.coalesce(F.size(F.filter(column, lambda m: m < bound)), F.lit(0))


def still_counts(frames: DataFrame, *, key: str, t: str, points: str, back: float = 0.5, tolerance: float = 0.1, radius: float = 1.5, half_x: float = 47.0) -> DataFrame:
    """(key, t, visible, still, frontcourt): still_counts_by_radius for one radius."""
    rows = still_counts_by_radius(frames, key=key, t=t, points=points, radii=[radius], back=back, tolerance=tolerance, half_x=half_x)
    return rows.select(key, t, "visible", F.col("stills")[0].alias("still"), "frontcourt")


def median_speed(df: DataFrame, *, key: list[str], t: str = "t", x: str = "x", y: str = "y") -> DataFrame:
    """(key, speed, erratic): the median frame-to-frame speed, one decimal; over 15 is erratic."""
    w = Window.partitionBy(*key).orderBy(t)
    dt = F.col(t) - F.lag(t).over(w)
    v = F.when(dt > 0, F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) / dt)
    out = df.withColumn("_v", v).groupBy(*key).agg(F.coalesce(F.round(F.median("_v"), 1), F.lit(0.0)).alias("speed"))
    return out.withColumn("erratic", F.col("speed") > 15)


def epoch_ids(df: DataFrame, *, key: str, order: str, cut: str, track: str, chunk: Column) -> DataFrame:
    """Track ids that begin anew after each cut: chunk * 1,000,000 + cuts so far * 1,000 + track."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("epoch_id", chunk * 1_000_000 + F.sum(F.col(cut).cast("int")).over(w) * 1000 + F.col(track))


def filled_and_smoothed(df: DataFrame, *, key: list[str], order: str, value: str) -> DataFrame:
    """df plus filled (linear between known rows, held at the edges) and smooth (mean of five, edges repeated)."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(order, value))
    d = df.withColumn("_a", F.last(known, True).over(before)).withColumn("_b", F.first(known, True).over(after))
    span = F.nullif(F.col(f"_b.{order}") - F.col(f"_a.{order}"), F.lit(0))
    line = F.col(f"_a.{value}") + (F.col(f"_b.{value}") - F.col(f"_a.{value}")) * (F.col(order) - F.col(f"_a.{order}")) / span
    d = d.withColumn("filled", F.coalesce(line, f"_a.{value}", f"_b.{value}"))
    w = Window.partitionBy(*key).orderBy(order)
    edge = lambda k: F.coalesce(F.lag("filled", k).over(w) if k > 0 else F.lead("filled", -k).over(w), F.first("filled").over(before) if k > 0 else F.last("filled").over(after))
    return d.withColumn("smooth", (edge(2) + edge(1) + F.col("filled") + edge(-1) + edge(-2)) / 5).drop("_a", "_b")


def trailing(df: DataFrame, *, key: str, order: str, width: int, **aggregates: Column) -> DataFrame:
    """df plus aggregates over the rows of the last `width` of order, the row itself included."""
    w = Window.partitionBy(key).orderBy(order).rangeBetween(-width, 0)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def followed_by(df: DataFrame, *, key: str, order: list[str], what: Column, t: str, within: float, out: str = "followed") -> DataFrame:
    """df plus out: whether `what` holds for the next row of the key, less than `within` later."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_hit", what).withColumn(out, F.coalesce(F.lead("_hit").over(w) & (F.lead(t).over(w) - F.col(t) < within), F.lit(False))).drop("_hit")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node) of all nodes reached from start (node) along edges (src, dst), themselves included, however far.

    Each round adds the nodes one step further that are new, and is checkpointed, so plans do not grow; the rounds end
    when there are none.
    """
    links = checkpointed(edges.select(F.col("src").alias("node"), "dst").distinct())
    reached = frontier = checkpointed(start.select("node").distinct())
    while True:
        step = frontier.join(links, "node").select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(reached, "node", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = checkpointed(reached.unionByName(frontier))


def resolved_labels(chain: DataFrame, depth: int = 10) -> DataFrame:
    """(id, name) from (id, label): labels merge:<id> are followed for at most `depth` steps; discarded, unset and
    circular ones are null.

    Each round doubles the steps taken, so that `depth` steps are a handful of joins; the steps are counted.
    """
    to = F.when(F.col("label").startswith("merge:"), F.substring("label", 7, 1 << 20))
    name = F.when(to.isNull() & (F.col("label") != "discard") & (F.col("label") != ""), F.col("label"))
    d = chain.select("id", to.alias("_next"), name.alias("name"), F.when(to.isNotNull(), 1).otherwise(0).alias("_steps"))
    steps = 1
    while steps < depth + 1:
        other = d.select(F.col("id").alias("_o"), F.col("_next").alias("_n2"), F.col("name").alias("_name2"), F.col("_steps").alias("_s2"))
        d = d.join(other, F.col("_next") == F.col("_o"), "left").select("id", F.col("_n2").alias("_next"), F.coalesce("name", "_name2").alias("name"), (F.col("_steps") + F.coalesce("_s2", F.lit(0))).alias("_steps"))
        steps *= 2
    return d.select("id", F.when(F.col("_steps") <= depth, F.col("name")).alias("name"))


def labelled_records(records: DataFrame, chain: DataFrame, *, cluster: str = "cluster") -> DataFrame:
    """records plus set_name: the resolved name of their cluster, null where it has none. chain is of the clusters'
    number and left to Spark's size estimate."""
    names = resolved_labels(chain).select(F.col("id").alias("_cluster"), F.col("name").alias("set_name"))
    return records.join(names, F.col(cluster).cast("string") == F.col("_cluster"), "left").drop("_cluster")
