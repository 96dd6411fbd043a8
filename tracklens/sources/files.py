"""Sources and sinks: JSON lines with explicit schemas, game summaries, registry, labels, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans import spec


class EmptySource(ValueError):
    """A source that must have rows has none."""


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One record a line; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Frames of one file or of a glob of chunks, missing fields filled; no frames at all are an error."""
    f = read_jsonl(spark, path, spec.FRAMES)
    f = f.withColumn("detections", F.coalesce("detections", F.expr(f"cast(array() as array<{spec.DETECTION}>)"))).withColumn("numbers", F.coalesce("numbers", F.expr("cast(array() as array<struct<track_id:int,text:string>>)"))).withColumn("shot", F.coalesce("shot", F.lit(False)))
    f = f.withColumn("source_file", F.input_file_name())
    if f.isEmpty():
        raise EmptySource(f"no frames in {path}")
    return f


def read_possessions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, spec.POSSESSIONS)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Scoreboard reads; NaN counts as missing."""
    return read_jsonl(spark, path, spec.READS).withColumn("clock", F.nanvl("clock", F.lit(None).cast("double")))


def read_records(records: DataFrame, *, order: str | None = None) -> DataFrame:
    """Records keyed game:period:index, of which the last duplicate counts: by `order`, else by file name and place in
    the file (records read from files)."""
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()) if order is None else F.col(order)
    keyed = records.withColumn("_o", place).withColumn("key", F.concat_ws(":", "game_id", "period", "index"))
    return keyed.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("_o")))).filter("_n = 1").drop("_n", "_o")


def read_feature_rows(spark: SparkSession, vectors: str, index: str) -> DataFrame:
    """Vectors joined with their index; different row counts are an error."""
    v, i = spark.read.parquet(vectors), spark.read.parquet(index)
    if v.count() != i.count():
        raise ValueError(f"{vectors} and {index} differ in rows")
    return v.join(i, "key")


def checked_registry(games: DataFrame, layouts: list[str], splits: tuple[str, ...] = ("train", "holdout")) -> DataFrame:
    """games plus `fault`: what is wrong with each row, null if nothing is."""
    repeated = F.count("*").over(Window.partitionBy("espn_id")) > 1
    fault = (
        F.when(~F.coalesce(F.col("layout").isin(*layouts), F.lit(False)), "unknown layout").when(~F.coalesce(F.col("split").isin(*splits), F.lit(False)), "unknown split")
        .when(F.try_to_date(F.col("date"), "yyyy-MM-dd").isNull(), "bad date").when(F.coalesce(F.length("youtube_id"), F.lit(0)) != 11, "bad video id").when(repeated, "repeated id")
    )
    return games.withColumn("fault", fault)


def read_registry(spark: SparkSession, path: str, layouts: list[str]) -> DataFrame:
    """The registry; any faulty row is an error."""
    games = checked_registry(spark.read.schema(spec.REGISTRY).option("multiLine", "true").json(path), layouts)
    checked = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(": ", "espn_id", "fault")).cast("string")).otherwise(F.col("espn_id"))
    return games.withColumn("espn_id", checked).drop("fault")


def get_game(games: DataFrame, game: str) -> DataFrame:
    found = games.filter(F.col("espn_id") == game)
    if found.isEmpty():
        raise KeyError(game)
    return found


def video_url(youtube_id):
    return F.concat(F.lit("https://www.youtube.com/watch?v="), youtube_id)


def game_path(root: str, game: str, name: str) -> str:
    """Where a game's table lies: the partition scheme of all outputs."""
    return f"{root}/game_id={game}/{name}"


def cached_summaries(spark: SparkSession, root: str, games: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summaries (game_id and the summary's fields) of games (game_id) through a cache, a folder a game under root.

    Games that the cache lacks are fetched (fetch gets their ids and gives summaries) and written to it first; then the
    cache is read, of which a filter on game_id reads only the folders that it names. A fetched game overwrites its own
    folder alone.
    """
    schema = f"{spec.SUMMARY}, game_id string"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(schema).json(root).select("game_id").distinct() if there else spark.createDataFrame([], "game_id string")
    missing = games.select(F.col("game_id").cast("string").alias("game_id")).distinct().join(known, "game_id", "left_anti")
    if not missing.isEmpty():
        fetched = fetch(missing)
        fetched.write.partitionBy("game_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(root)
    wanted = games.select(F.col("game_id").cast("string").alias("game_id")).distinct()
    return spark.read.schema(schema).json(root).join(F.broadcast(wanted), "game_id", "left_semi")  # ids of a registry


def summary_tables(summaries: DataFrame) -> dict[str, DataFrame]:
    """Flat tables of game summaries (game_id, header, boxscore, plays): teams, roster, periods and plays.

    Only the first statistics block counts, and athletes without a number are left out. A game needs a home and an
    away side.
    """
    sides = summaries.select("game_id", F.inline(F.col("header.competitions")[0]["competitors"]))
    teams = sides.select("game_id", F.col("homeAway").alias("side"), F.col("team.id").alias("team_id"), X.short_name(F.col("team.displayName"), F.col("team.name")).alias("team"), F.col("team.color").alias("color"))
    box = summaries.select("game_id", F.explode("boxscore.players").alias("_p")).select("game_id", F.col("_p.team.id").alias("team_id"), F.explode(F.get(F.col("_p.statistics"), F.lit(0))["athletes"]).alias("_a"))
    roster = box.filter(F.trim(F.coalesce("_a.athlete.jersey", F.lit(""))) != "").select("game_id", "team_id", F.col("_a.athlete.jersey").alias("jersey"), F.col("_a.athlete.displayName").alias("name"), F.coalesce("_a.starter", F.lit(False)).alias("starter")).join(teams.select("game_id", "team_id", "team"), ["game_id", "team_id"])
    periods = summaries.select("game_id", F.sort_array(F.array_distinct(F.transform("plays", lambda p: p["period"]["number"]))).alias("periods"))
    return {"teams": teams, "roster": roster, "periods": periods, "plays": parsed_plays(summaries, teams)}


def sides_of(teams: DataFrame) -> DataFrame:
    """(game_id, home, away); a missing side is an error."""
    s = teams.groupBy("game_id").agg(F.max(F.when(F.col("side") == "home", F.col("team"))).alias("home"), F.max(F.when(F.col("side") == "away", F.col("team"))).alias("away"))
    bad = F.col("home").isNull() | F.col("away").isNull()
    return s.withColumn("home", F.when(bad, F.raise_error(F.concat(F.lit("no home or away side in "), F.col("game_id"))).cast("string")).otherwise(F.col("home")))


def parsed_plays(summaries: DataFrame, teams: DataFrame) -> DataFrame:
    """Plays with a clock, in order: their texts normalised, unknown teams null, missing numbers 0."""
    p = summaries.select("game_id", F.posexplode("plays").alias("seq", "_p"))
    clock = X.clock_seconds(F.coalesce("_p.clock.displayValue", F.lit("")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = p.select(
        "game_id", "seq", F.col("_p.period.number").alias("period"), F.coalesce("_p.clock.displayValue", F.lit("")).alias("clock_text"), clock.alias("clock"), F.col("_p.team.id").alias("team_id"),
        F.coalesce("_p.type.text", F.lit("")).alias("type"), X.normalized_play(F.coalesce("_p.text", F.lit(""))).alias("text"), F.coalesce("_p.scoringPlay", F.lit(False)).alias("scoring"),
        zero("_p.scoreValue").alias("score_value"), zero("_p.awayScore").alias("away_score"), zero("_p.homeScore").alias("home_score"),
    ).filter("clock is not null")
    return rows.join(teams.select("game_id", "team_id", "team"), ["game_id", "team_id"], "left").drop("team_id")


def home_check(games: DataFrame, teams: DataFrame, team: str) -> DataFrame:
    """(espn_id, check) for every game of the registry: "ok" where its flag `home` agrees with the side on which the
    summary (teams: game_id, side, team) has `team`, "mismatch" where not, "unknown" where the summary has no such side
    or there is none; never an error."""
    of_team = teams.filter(F.col("team") == team)
    at_home = of_team.groupBy(F.col("game_id").alias("_game")).agg(F.max(F.col("side") == "home").alias("_at_home"))
    j = games.join(at_home, F.col("espn_id") == F.col("_game"), "left")
    known = F.col("_at_home").isNotNull() & F.col("home").isNotNull()
    return j.select("espn_id", F.when(~known, "unknown").when(F.col("home") == F.col("_at_home"), "ok").otherwise("mismatch").alias("check"))


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """The label maps; a missing file gives empty ones."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(spec.LABELS).option("multiLine", "true").json(path)
    empty = "cast(map() as map<string,string>)"
    return spark.range(1).selectExpr(f"{empty} clusters", f"{empty} validation", f"{empty} defense", "1 version")


def save_labels(labels: DataFrame, path: str) -> None:
    ordered = lambda c: F.map_from_entries(F.sort_array(F.map_entries(c)))
    labels.select(*[ordered(c).alias(c) for c in ("clusters", "validation", "defense")], "version").coalesce(1).write.mode("overwrite").json(path)  # one row


def images_as_data_uris(spark: SparkSession, path: str) -> DataFrame:
    """(path, uri) of the existing files of a glob; the type is that of the file's name, PNG where it tells none."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kind = F.when(ending.isin("jpg", "jpeg"), "jpeg").when(ending == "svg", "svg+xml").when(ending.isin("gif", "webp"), ending).otherwise("png")
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64("content")).alias("uri"))


def write_csv(df: DataFrame, path: str) -> None:
    """A table of reports, with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def json_parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with a column of JSON texts as structs; texts that do not fit give null fields."""
    return df.withColumn(column, F.from_json(column, schema))


def json_written(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.to_json(column))


def chosen_games(games: DataFrame, *, only: list[str] | None = None, layouts: list[str] | None = None, split: str | None = None, limit: int = 0) -> DataFrame:
    """Games of the registry by ids, layouts and split; the first `limit` by date and id (0: all)."""
    for column, values in (("espn_id", only), ("layout", layouts), ("split", [split] if split else None)):
        games = games.filter(F.col(column).isin(*values)) if values else games
    return games.orderBy("date", "espn_id").limit(limit) if limit else games


def cost_of(log: DataFrame, line: str = "line") -> DataFrame:
    """log plus cost: the dollars that a line of a job's output states ("estimated cost: $6.99"), else null."""
    return log.withColumn("cost", F.regexp_extract(line, r"(?i)cost[^$]*\$\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"))


def corpus_of(spark: SparkSession, root: str, games: list[str], name: str, schema: str) -> DataFrame:
    """All games' records in one read."""
    return read_jsonl(spark, [game_path(root, g, name) for g in games], schema)
