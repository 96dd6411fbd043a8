"""The scoreboard, the play-by-play and their streams over the derived games: against plain versions of the rules, and
against the plan of the game that the rows are derived from."""

from collections import Counter
from datetime import timedelta
from itertools import groupby

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracklens import catalog_game as G
from tracklens.operators import scoreboard as B
from tracklens.operators import states as S
from tracklens.streaming import events as ST
from tracklens.streaming import machines as M


def run(spark, sf_dir, name):
    return [r.asDict() for r in entry.queries()[name](spark, sf_dir).collect()]


def grouped(rows, *keys):
    key = lambda r: tuple(r[k] for k in keys)
    return {k: list(g) for k, g in groupby(sorted(rows, key=key), key=key)}


def plain_clock(reads):
    """reads [(t, [candidates])] -> the accepted value of each, by looking at everything anew for each read."""
    accepted = []
    for i, (t, mine) in enumerate(reads):
        past = [(when, v) for when, v in accepted if v is not None]
        allowed = lambda v: not past or past[-1][1] + 0.5 >= v >= past[-1][1] - (t - past[-1][0]) - 120.0
        next_to = [v for k in {i - 1, i + 1} & set(range(len(reads))) for v in reads[k][1]]
        fine = [v for v in mine if allowed(v) and any(abs(v - o) <= 2.0 for o in next_to)]
        choice = sorted(fine, key=lambda v: abs(v - past[-1][1]) if past else 0)[:1]
        if not choice and mine:
            ahead = [(u, c) for u, c in reads[i + 1 : i + 61] if c][:5]
            if len(ahead) == 5:
                off = lambda speed: max(min(abs(v - (mine[0] - speed * (u - t))) for v in c) for u, c in ahead)
                not_too_deep = not past or mine[0] >= past[-1][1] - (t - past[-1][0]) - 120.0
                if off(1) <= 1.5 or (not_too_deep and off(0) <= 1.5):
                    choice = mine[:1]
        accepted.append((t, choice[0] if choice else None))
    return [v for _, v in accepted]


def read_digits(text):
    """What three or four digits can mean: tenths (two or three digits), or minutes and seconds."""
    out = [int(text) / 10] if len(text) in (2, 3) and int(text) / 10 < 60 else []
    minutes, seconds = int(text[:-2]), int(text[-2:])
    return out + ([minutes * 60 + seconds] if seconds < 60 and (len(text) == 3 or (len(text) == 4 and minutes <= 20)) else [])


def candidates(r):
    return read_digits(r["clock_text"]) if r["clock_text"] else [] if r["clock"] is None else [r["clock"]]


def test_periods_are_those_of_the_plan(spark, sf_dir):
    spans = grouped(run(spark, sf_dir, "period_spans"), "game")
    last = {k[0]: max(r["t"] for r in v) for k, v in grouped([r.asDict() for r in G.scoreboard(spark, sf_dir).collect()], "game").items()}
    assert any(len(rows) == 3 for rows in spans.values())
    for (game,), rows in spans.items():
        starts = [r["t_lo"] for r in sorted(rows, key=lambda r: r["period"])]
        assert starts == [s for _, s, _ in G.PERIODS if s + 62 < last[game]][: len(starts)] and [r["period"] for r in sorted(rows, key=lambda r: r["period"])] == list(range(1, len(rows) + 1))


def test_known_scores_and_clock_equal_plain_rules(spark, sf_dir):
    ours = grouped(run(spark, sf_dir, "score_timeline_known"), "game", "period")
    reads = grouped([r.asDict() for r in G._in_periods(G.scoreboard(spark, sf_dir)).collect()], "game", "period")
    states = {(r["game"], r["period"]): [tuple(s) for s in r["states"]] for r in G.score_states(spark, sf_dir).collect()}
    assert set(ours) == set(reads)
    for key, rows in reads.items():
        rows.sort(key=lambda r: r["t"])
        got = sorted(ours[key], key=lambda r: r["t"])
        assert [r["t"] for r in got] == [r["t"] for r in rows]
        assert [r["clock"] for r in got] == plain_clock([(r["t"], candidates(r)) for r in rows])
        pairs, latest = [(r["away"], r["home"]) for r in rows], None
        for i, (r, pair) in enumerate(zip(got, pairs)):
            place = states[key].index(pair) if pair in states[key] else None
            repeated = pair in pairs[max(0, i - 1) : i] + pairs[i + 1 : i + 2]
            fine = place is not None and (latest is None or place >= latest) and (repeated or place == latest)
            latest = place if fine else latest
            assert (r["away"], r["home"]) == (pair if fine else (None, None))


def test_every_kind_of_misread_occurs_and_the_clock_locks_again(spark, sf_dir):
    kinds = {(r["game"], float(r["second"])): r["h"] for r in G.game_time(spark, sf_dir).filter("period is not null").collect()}
    rows = {(r["game"], r["t"]): r for r in run(spark, sf_dir, "score_timeline_known")}
    of = lambda h: [rows[k] for k in kinds if kinds[k] == h]
    assert len(rows) > 1000 and min(len(of(h)) for h in (5, 11, 17, 23, 29, 31)) > 0
    assert all(r["clock"] is None for h in (5, 17) for r in of(h))
    assert all((r["away"], r["home"]) == (None, None) for h in (29, 31) for r in of(h))
    assert any(r["clock_text"] for r in of(23))
    again = 0
    for (game, t), h in kinds.items():
        wrong, later = rows[game, t], rows.get((game, t + 4.0))
        if h == 11 and wrong["clock"] is not None and later and later["clock"] is not None:
            again += later["clock"] > wrong["clock"] + 50
    assert again > 0  # a clock taken too low is left for the true one above it
    trusted = sum(r["clock"] is not None for r in rows.values()) / len(rows)
    assert 0.9 < trusted < 1


def test_periods_found_are_cleaned_apart(spark, sf_dir):
    """With the spans found, nearly all reads of play keep the plan's clock."""
    plan = {(r["game"], float(r["second"])): r["clock"] for r in G.game_time(spark, sf_dir).filter("clock is not null").collect()}
    rows = [r for r in run(spark, sf_dir, "score_timeline_clean") if (r["game"], r["t"]) in plan]
    assert sum(r["clock"] == plan[r["game"], r["t"]] for r in rows) > 0.93 * len(rows)
    assert {r["period"] for r in rows} >= {1, 2}


def test_intervals_of_the_plan(spark, sf_dir):
    """All ends and starts occur; an interval is bounded by what its plays say."""
    intervals = run(spark, sf_dir, "pbp_intervals")
    assert set(Counter(i["terminal"] for i in intervals)) == {"shot", "turnover", "foul", "stoppage", "period_end"}
    assert {"live", "dead", "ato"} <= {i["start_type"] for i in intervals} and {i["free_throws"] for i in intervals} == {True, False}
    plays = grouped([r.asDict() for r in G.plays(spark, sf_dir).collect()], "game", "period")
    for key, rows in grouped(intervals, "game", "period").items():
        rows.sort(key=lambda r: r["index"])
        own = {p["seq"]: p for p in plays[key]}
        assert [r["index"] for r in rows] == list(range(len(rows)))
        assert all(a["end_clock"] >= b["start_clock"] or a["terminal"] == "shot" for a, b in zip(rows, rows[1:]))
        for r in rows:
            assert r["start_clock"] > r["end_clock"]
            inside = [own[s] for s in r["events"]]
            assert all(p["clock"] <= r["start_clock"] for p in inside) and r["events"] == sorted(set(r["events"]))
            last = inside[-1] if inside else None
            if r["terminal"] == "turnover" and "Turnover" in last["type"]:
                assert last["team"] == r["team"] and last["clock"] == r["end_clock"]
            if r["terminal"] == "foul":
                after = own[last["seq"] + 1]
                assert last["team"] != r["team"] and r["free_throws"] and "free throw" in after["text"] and after["team"] == r["team"] and after["clock"] == last["clock"]
            if r["terminal"] == "period_end":
                assert r["end_clock"] == 0.0 and r is rows[-1]


# --- streams ------------------------------------------------------------------------------------------------------


def same(a, b):
    key = lambda rows: sorted(repr(sorted(r.items())) for r in rows)
    assert len(a) == len(b) and key(a) == key(b)


def test_streams_equal_batches_over_four_runs(spark, sf_dir):
    same(run(spark, sf_dir, "stream_clock"), run(spark, sf_dir, "score_timeline_known"))
    same(run(spark, sf_dir, "stream_intervals"), run(spark, sf_dir, "pbp_intervals"))


def clock_rows(spark, n=400, seed=1):
    import random

    rng, rows = random.Random(seed), []
    for i in range(n):
        clock = None if rng.random() < 0.2 else 1200.0 - i + (rng.choice([0, 0, 0, 60, -90]) if rng.random() < 0.2 else 0)
        rows.append(("g", i, float(i), clock, None, 2 * (i // 60) if rng.random() < 0.9 else 99, 3 * (i // 80)))
    df = spark.createDataFrame(rows, "game string, s int, t double, clock double, clock_text string, away int, home int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")


def test_rows_out_of_order_within_the_delay_are_put_in_order(spark):
    """Reads without score states, in three parts that overlap by some seconds; the last read comes out too."""
    df = clock_rows(spark)
    at = F.unix_seconds("ts") - 1_000_000
    parts = [df.filter((at < 140) & (at % 7 != 3)), df.filter((at < 140) & (at % 7 == 3) & (at > 120) | at.between(140, 260)), df.filter(at > 260)]
    kept = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = ST.run_parts(parts, lambda r: M.clean_timeline_stream(r, keys=["game"], ts="ts", late="30 seconds", idle=timedelta(hours=1)), name="order")
    got, want = [[r.asDict() for r in d.collect()] for d in (out, B.clean_timeline(kept.drop("ts"), keys=["game"]))]
    assert max(r["t"] for r in got) == 399.0 and sum(r["clock"] is not None for r in got) > 200
    same(got, want)


def test_state_ends_with_the_key_and_reads_are_held_no_longer_than_needed(spark):
    """Without a heartbeat only what is certain comes out; after a pause the key begins anew."""
    df = clock_rows(spark, 300)
    later = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 HOURS")).withColumn("t", F.col("t") + 7200)
    step = lambda r: M.clean_timeline_stream(r, keys=["game"], ts="ts", late="5 seconds", idle=timedelta(minutes=10))
    open_ended = ST.run_parts([df.filter("t < 150"), df.filter("t >= 150")], step, name="held", end=False)
    assert 200 < open_ended.count() < 300
    both = ST.run_parts([df, later], step, name="anew")
    want = [r.asDict() for r in B.clean_timeline(df.drop("ts"), keys=["game"]).collect()]
    same([r.asDict() for r in both.collect()], [*want, *[r | {"t": r["t"] + 7200} for r in want]])


def test_the_interval_machine_carries_over_at_any_play(spark):
    """Saved and restored as JSON after each play it cuts the same intervals."""
    import json

    from test_states import PLAYS, play

    whole = S.cut_intervals([play(*p) for p in PLAYS], 1200.0)
    machine, found = S.Intervals(["Reds", "Blues"], 1200.0), []
    for p in PLAYS:
        machine.play(play(*p))
        found += machine.taken()
        machine = S.Intervals.restored(json.loads(json.dumps(machine.saved())))
    assert found == whole and len(whole) == 7


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_runs_of_labels(spark, order):
    rows = [[("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x")], [("a", 1000, "z"), ("b", 1001, "y")], [("a", 2000, "x")]]
    parts = [spark.createDataFrame(rows[i], "k string, s int, label string").select("k", F.timestamp_seconds("s").alias("ts"), "label") for i in order]
    out = ST.run_parts(parts, lambda r: M.runs_of_labels(r, key="k", label="label", late="1 hour"), name="runs")
    assert {tuple(r) for r in out.filter("k is not null").collect()} == {("a", 3), ("b", 1)}
