"""Clock, score and play-by-play text as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shot nouns in the order in which they are lower-cased.
SHOT_NOUNS = ("Three Point Jumper", "Two Point Tip Shot", "Free Throw", "Layup", "Jumper", "Dunk")
# Words of play types that stop the ball.
DEAD_BALL_WORDS = ("foul", "free throw", "substitution", "timeout", "subbing", "challenge", "jumpball")
# Name suffixes.
NAME_SUFFIXES = ("jr.", "jr", "sr.", "sr", "ii", "iii", "iv")


def normalized_play(text: Column) -> Column:
    """Past-tense play texts in the present-tense dialect; present-tense texts stay as they are."""
    text = F.regexp_replace(text, r"(?i)\bmade\b", "makes")
    text = F.regexp_replace(text, r"(?i)\bmissed\b", "misses")
    text = F.regexp_replace(text, r"\.?\s*Assisted by (.+)\.\s*$", " ($1 assists)")
    for noun in SHOT_NOUNS:
        text = F.regexp_replace(text, f"(?i){noun}", noun.lower())
    return text


def clock_seconds(text: Column) -> Column:
    """Seconds of mm:ss or ss.t, else null."""
    t = F.trim(text)
    minutes = F.try_to_number(F.regexp_extract(t, r"^(\d{1,2}):\d{2}$", 1), F.lit("99")).cast("double") * 60
    seconds = F.regexp_extract(t, r"^\d{1,2}:(\d{2})$", 1).try_cast("double")
    return F.when(t.rlike(r"^\d{1,2}:\d{2}$"), minutes + seconds).when(t.rlike(r"^\d{1,2}\.\d$"), t.try_cast("double"))


def clock_candidates(text: Column) -> Column:
    """array<struct<value, text>>: what an optically read clock can mean, likeliest first.

    A lost colon or point is taken into account: 311 may be 3:11 or 31.1.
    """
    t = F.trim(text)
    digits = F.regexp_replace(t, r"\D", "")
    n = F.length(digits)
    number = lambda a, b: F.substring(digits, a, b).try_cast("int")
    pair = lambda v, s: F.struct(v.cast("double").alias("value"), s.alias("text"))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    colon, point = t.rlike(r"^\d{1,2}:\d{2}$"), t.rlike(r"^\d{1,2}\.\d$")
    mm, ss = F.split_part(t, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(t, F.lit(":"), F.lit(2)).try_cast("int")
    exact = F.when(colon & (mm <= 20) & (ss < 60), pair(mm * 60 + ss, F.concat(mm.cast("string"), F.lit(":"), two(ss))))
    value = t.try_cast("double")
    tenths = F.when(point & (value < 60), pair(value, F.format_string("%.1f", value)))
    bare = ~colon & ~point
    four = F.when(bare & (n == 4) & (number(1, 2) <= 20) & (number(3, 2) < 60), pair(number(1, 2) * 60 + number(3, 2), F.concat(number(1, 2).cast("string"), F.lit(":"), F.substring(digits, 3, 2))))
    three = F.when(~colon & (n == 3) & (number(2, 2) < 60), pair(number(1, 1) * 60 + number(2, 2), F.concat(F.substring(digits, 1, 1), F.lit(":"), F.substring(digits, 2, 2))))
    tenth = digits.try_cast("int") / 10
    lost = F.when(bare & n.between(2, 3) & (tenth < 60), pair(tenth, F.format_string("%.1f", tenth)))
    return F.array_compact(F.array(exact, tenths, four, three, lost))


def parsed_score(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits).between(1, 3), digits.try_cast("int"))


def jersey_number(text: Column) -> Column:
    """At most two digits without leading zeros, 0 itself stays; else null."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits).between(1, 2), digits.try_cast("int").cast("string"))


def clock_rank(text: Column) -> Column:
    """(is m:ss, digits) of a clock text; a missing one is least."""
    return F.when(text.isNull(), F.struct(F.lit(-1).alias("shape"), F.lit(-1).alias("digits"))).otherwise(
        F.struct(F.when(text.rlike(r"^\d{1,2}:\d{2}$"), 1).otherwise(0).alias("shape"), F.length(F.regexp_replace(text, r"\D", "")).alias("digits"))
    )


def picked_clock(texts: Column) -> Column:
    """Place, from 0, of the reading to trust: the first if it is m:ss, else the best rank, the earliest on ties."""
    ranks = F.transform(texts, clock_rank)
    best = F.array_position(ranks, F.array_max(ranks)).cast("int") - 1
    return F.when(F.coalesce(F.try_element_at(texts, F.lit(1)).rlike(r"^\d{1,2}:\d{2}$"), F.lit(False)), 0).otherwise(best)


def plausible_reading(text: Column) -> Column:
    digits, t = F.regexp_replace(text, r"\D", ""), F.trim(text)
    tenths = t.rlike(r"^\d{1,2}\.\d$") & (t.try_cast("double") < 60)
    four = t.rlike(r"^\d{4}$") & (F.substring(digits, 1, 2).try_cast("int") <= 20) & (F.substring(digits, 3, 2).try_cast("int") < 60)
    return t.rlike(r"^\d{1,2}:[0-5]\d$") | F.coalesce(tenths, F.lit(False)) | F.coalesce(four, F.lit(False)) | t.rlike(r"^\d{1,2}$")


def picked_reading(texts: Column) -> Column:
    """Of several readings of one crop: plausible ones first, then most digits, most agreement, longest, earliest."""
    key = lambda t, i: F.struct(
        F.when(plausible_reading(t), 0).otherwise(1).alias("a"), (-F.length(F.regexp_replace(t, r"\D", ""))).alias("b"), (-F.size(F.filter(texts, lambda o: o == t))).alias("c"), (-F.length(t)).alias("d"), i.alias("e"), t.alias("t")
    )
    return F.array_min(F.transform(texts, key))["t"]


def glyph_vote(texts: Column, length: int) -> Column:
    """The plurality character at each place of readings of one length; on ties the one that was read first."""
    places = []
    for k in range(1, length + 1):
        places.append(F.array_min(_tally(_chars_at(texts, k)))["c"])
    return F.concat(*places)


def _chars_at(texts: Column, place: int) -> Column:
    return F.transform(texts, lambda t: F.substring(t, place, 1))


def _tally(chars: Column) -> Column:
    """Distinct characters as they came first, the most frequent ones least in order."""
    return F.transform(F.array_distinct(chars), lambda c, i: F.struct((-F.size(F.filter(chars, lambda o: o == c))).alias("n"), i.alias("i"), c.alias("c")))


def clock_label(seconds: Column) -> Column:
    """m:ss from a minute on, else seconds with a decimal; null for a missing clock."""
    whole = F.floor(seconds / 60).cast("int")
    return F.when(seconds >= 60, F.format_string("%d:%02d", whole, F.floor(seconds - whole * 60).cast("int"))).when(seconds.isNotNull(), F.format_string("%.1f", seconds))


def surname(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: (p != "") & ~F.lower(p).isin(*NAME_SUFFIXES))
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), name)


def track_label(team: Column, jersey: Column, name: Column, track_id: Column) -> Column:
    short = F.upper(F.substring(F.coalesce(team, F.lit("?")), 1, 3))
    return F.when(name.isNotNull(), F.concat(short, F.lit(" #"), F.coalesce(jersey, F.lit("None")), F.lit(" "), surname(name))).when(jersey.isNotNull(), F.concat(short, F.lit(" #"), jersey)).otherwise(F.concat(short, F.lit(" id"), track_id.cast("string")))


def short_name(display: Column, nickname: Column) -> Column:
    """The display name without its closing nickname."""
    return F.when(display.endswith(F.concat(F.lit(" "), nickname)), F.substring(display, F.lit(1), F.length(display) - F.length(nickname) - 1)).otherwise(display)


def clip_name(possession_id: Column, start: Column, team: Column, outcome: Column) -> Column:
    tail = F.regexp_replace(F.lower(F.concat_ws("_", F.coalesce(team, F.lit("unknown")), outcome)), r"\s+", "-")
    return F.concat(F.format_string("p%03d_%04ds_", possession_id, F.floor(start).cast("int")), tail)


# Play-by-play predicates. All compare in lower case.


def _has(column: Column, *words: str) -> Column:
    low = F.lower(F.coalesce(column, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def is_free_throw(text):
    return _has(text, "free throw")


def is_made(text):
    return _has(text, " makes ")


def is_shot(text):
    return _has(text, " makes ", " misses ") & ~is_free_throw(text)


def is_turnover(kind, text):
    return _has(F.concat_ws(" ", kind, text), "turnover")


def is_steal(kind):
    return _has(kind, "steal")


def is_foul(kind):
    return _has(kind, "foul")


def is_timeout(kind):
    return _has(kind, "timeout")


def rebound_kind(kind):
    """defensive, offensive or dead, else null."""
    low = F.lower(kind)
    return F.when(low.startswith("defensive rebound"), "defensive").when(low.startswith("offensive rebound"), "offensive").when(low.startswith("dead ball rebound"), "dead")


def is_jump_ball(kind):
    return _has(kind, "jumpball")


def is_substitution(kind, text):
    return _has(kind, "substitution") | _has(text, "subbing")


def is_period_end(kind):
    return F.lower(kind) == "end period"


def is_offensive(kind, text):
    return is_shot(text) | is_turnover(kind, text) | _has(text, "offensive rebound")


def is_dead_ball(kind, text):
    return _has(F.concat_ws(" ", kind, text), *DEAD_BALL_WORDS)


def free_throw_trip(text):
    """(number, of) of "free throw 1 of 2", else nulls."""
    part = lambda k: F.nullif(F.regexp_extract(F.lower(text), r"free throw (\d) of (\d)", k), F.lit("")).cast("int")
    return part(1), part(2)


def event_style(kind: Column, text: Column, score_value: Column) -> Column:
    """A short tag for an event; null for substitutions, which are not shown."""
    three = _has(text, "three point")
    value = F.coalesce(F.nullif(score_value, F.lit(0)), F.when(three, 3).otherwise(2))
    return (
        F.when(is_substitution(kind, text), None)
        .when(is_free_throw(text), F.when(is_made(text), "FT MADE").otherwise("FT MISSED"))
        .when(is_made(text), F.concat(F.lit("MADE +"), value.cast("string")))
        .when(_has(text, " misses "), F.when(three, "MISSED 3").otherwise("MISSED 2"))
        .when(is_turnover(kind, text), "TURNOVER")
        .when(_has(kind, "steal") | _has(text, "steal"), "STEAL")
        .when(_has(kind, "block"), "BLOCK")
        .when(_has(kind, "foul") | _has(text, "foul"), "FOUL")
        .when(_has(kind, "rebound"), F.when(_has(kind, "offensive"), "OFF REB").otherwise("DEF REB"))
        .when(_has(kind, "timeout"), "TIMEOUT")
        .otherwise(F.upper(F.coalesce(kind, F.lit("event"))))
    )


def shot_outcome(text: Column) -> Column:
    return F.concat(F.when(is_made(text), "made_").otherwise("missed_"), F.when(_has(text, "three point"), "3").otherwise("2"))


def period_length(period: Column) -> Column:
    return F.when(period <= 2, 1200.0).otherwise(300.0)


def clock_bucket(clock: Column) -> Column:
    return F.when(clock <= 120, "late").when(clock <= 600, "mid").otherwise("early")


def margin_bucket(margin: Column) -> Column:
    return F.when(margin.isNull(), "unknown").when(margin > 5, "ahead").when(margin < -5, "behind").otherwise("close")


def script_json(value: Column) -> Column:
    """JSON that is safe inside a script element: no end of an element and no line separators that scripts take for line
    ends; parsed, it is the value."""
    out = F.regexp_replace(F.to_json(value), "</", r"<\\/")
    return F.regexp_replace(F.regexp_replace(out, "\u2028", r"\\u2028"), "\u2029", r"\\u2029")


def region_map(spec_text: Column) -> Column:
    """map<name, array<int>> of k=a,b,c,d;..."""
    return F.transform_values(F.str_to_map(spec_text, F.lit(";"), F.lit("=")), lambda k, v: F.transform(F.split(v, ","), lambda x: F.trim(x).cast("int")))


def team_map(spec_text: Column, home: Column, away: Column) -> Column:
    """map<int, string> of "0=A" or "0=A,1=B", teams in any case of letters; one given side implies the other, "auto" is
    null. Other clusters, teams that are not of the game, and contradictions raise an error."""
    parts = F.transform(F.split(spec_text, ","), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("cluster"), F.lower(F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p)))).alias("team"), p.contains("=").alias("pair")))
    team = lambda t: F.when(t == F.lower(home), home).when(t == F.lower(away), away)
    wrong = F.exists(parts, lambda p: ~p["pair"] | ~p["cluster"].isin("0", "1") | team(p["team"]).isNull())
    of = lambda c: F.array_distinct(F.transform(F.filter(parts, lambda p: p["cluster"] == c), lambda p: team(p["team"])))
    zero, one = F.get(of("0"), F.lit(0)), F.get(of("1"), F.lit(0))
    against = (F.size(of("0")) > 1) | (F.size(of("1")) > 1) | F.coalesce(zero == one, F.lit(False))
    other = lambda t: F.when(t == home, away).otherwise(home)
    error = F.raise_error(F.concat(F.lit("bad team map: "), spec_text)).cast("map<int,string>")
    full = F.create_map(F.lit(0), F.coalesce(zero, other(one)), F.lit(1), F.coalesce(one, other(zero)))
    return F.when(F.lower(spec_text) == "auto", None).when(wrong | against, error).otherwise(full)
