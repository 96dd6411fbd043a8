"""Order-dependent machines over streams: a key's rows are held until the watermark has passed them, taken in order of
event time, and decided as soon as the rows that they must be compared with are there. Results do not depend on how the rows
are cut into batches.

State is two variables in the state store: the rows that wait, and what the machine carries on, as JSON. Both are bounded
by the watermark's delay and the machine's look-ahead. A timer at a key's last row decides what the watermark has closed
though no further row comes; one `idle` later ends the key: what still waits is decided with nothing after it, and all
its state goes.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql import functions as F

from ..operators import scoreboard as B
from ..operators import states as S


class Ordered(StatefulProcessor):
    """Base of the machines. A subclass has decide(key, rows, carried, final), which gets a key's closed rows as dicts
    in order and what was carried (None at first), and returns (output rows, how many rows are done with, carried)."""

    def __init__(self, columns: str, order: list[str], idle: timedelta):
        self.columns, self.order, self.idle = columns, order, int(idle.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.columns)
        self.carried = handle.getValueState("carried", "data string, last long, stop long, done long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        data, last, stop, done = self.carried.get() if self.carried.exists() else (None, -1, -1, -1)
        fresh = [tuple(r[c] for c in self._names()) for r in rows]
        newest = max(r[0] for r in fresh)
        if newest > last:
            if stop >= 0:
                self.handle.deleteTimer(stop)
            last, stop = newest, newest + self.idle
            self.handle.registerTimer(last)
            self.handle.registerTimer(stop)
        yield from self._advance(key, self._held() + fresh, (data, last, stop, done), timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.carried.exists():
            state = self.carried.get()
            yield from self._advance(key, self._held(), state, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() >= state[2])

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]

    def _advance(self, key, held: list[tuple], state: tuple, watermark: int, final: bool) -> Iterator[Row]:
        data, last, stop, done = state
        names = self._names()
        place = [names.index(c) for c in ["at", *self.order]]
        held.sort(key=lambda r: tuple((r[i] is not None, r[i]) for i in place))
        closed = len(held) if final else bisect_right([r[0] for r in held], watermark)
        as_rows = lambda a, b: [dict(zip(names, r, strict=True)) for r in held[a:b]]
        begin, before = 0, done
        for i in range(closed):  # a pause ends the key, whether its rows come in one batch or in two
            if before >= 0 and held[i][0] - before > self.idle:
                yield from self.decide(key, as_rows(begin, i), json.loads(data) if data else None, True)[0]
                data, begin, done = None, i, -1
            before = held[i][0]
        out, taken, carried = self.decide(key, as_rows(begin, closed), json.loads(data) if data else None, final)
        yield from out
        if final:
            self.waiting.clear()
            self.carried.clear()
            return
        done = held[begin + taken - 1][0] if taken else done
        if held[begin + taken :]:
            self.waiting.put(held[begin + taken :])
        else:
            self.waiting.clear()
        self.carried.update((json.dumps(carried), last, stop, done))

    def decide(self, key, rows: list[dict], carried, final: bool):
        raise NotImplementedError

    def close(self) -> None:
        pass


def run_machine(rows: DataFrame, machine: Ordered, *, keys: list[str], ts: str, late: str, out: str) -> DataFrame:
    """The machine's output, columns `keys` first, in append mode. rows are of a stream, with event times in ts."""
    kinds = dict(rows.dtypes)
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("at", F.unix_millis(ts))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + out
    return timed.groupBy(*keys).transformWithState(machine, schema, "Append", "EventTime")


# --- scoreboard ---------------------------------------------------------------------------------------------------


class Scoreboard(Ordered):
    """Cleans reads as they come: equal to scoreboard.clean_timeline over all of a key's reads. A read waits for the
    next one, and for the five readable ones (or sixty of any kind) that can bear it out."""

    COLUMNS = "at long, t double, c string, away int, home int, known boolean, place int"

    def __init__(self, keys: list[str], idle: timedelta):
        super().__init__(self.COLUMNS, ["t"], idle)
        self.keys = keys

    def decide(self, key, rows, carried, final):
        state = carried or {"clock": {}, "levels": [-1, -1], "best": -1, "before": None}
        before = state["before"]
        reads = [r | {"c": [(float(v), text) for v, text in json.loads(r["c"])]} for r in rows]
        values = [[v for v, _ in r["c"]] for r in reads]
        readable = [i for i, v in enumerate(values) if v]
        n = len(reads)
        ready = n if final else self._ready(readable, n)
        clock, out = B.Clock(**state["clock"]), []
        for i in range(ready):
            r = reads[i]
            near = (before["c"] if i == 0 and before else values[i - 1] if i else []) + (values[i + 1] if i + 1 < n else [])
            beside = [any(abs(x - v) <= B.BESIDE for x in near) for v in values[i]]
            k = clock.take(r["t"], values[i], beside, self._agree(reads, values, readable, i, 1), self._agree(reads, values, readable, i, 0))
            shown = r["c"][k] if k >= 0 else (None, None)
            last = (before["away"], before["home"]) if i == 0 and before else (reads[i - 1]["away"], reads[i - 1]["home"]) if i else None
            following = (reads[i + 1]["away"], reads[i + 1]["home"]) if i + 1 < n else None
            pair = (r["away"], r["home"])
            if r["known"]:
                if r["place"] is not None and pair in (last, following):
                    state["best"] = max(state["best"], r["place"])
                scores = pair if r["place"] is not None and r["place"] == state["best"] else (None, None)
            else:
                scores = []
                for s in (0, 1):
                    again = pair[s] is not None and pair[s] in [x[s] for x in (last, following) if x]
                    state["levels"][s] = B.levels([pair[s]], [again], state["levels"][s])[0]
                    scores.append(pair[s] if pair[s] == state["levels"][s] else None)
            out.append(Row(**dict(zip(self.keys, key, strict=True)), t=r["t"], clock=shown[0], clock_text=shown[1], away=scores[0], home=scores[1]))
        if ready:
            state["before"] = {"c": values[ready - 1], "away": reads[ready - 1]["away"], "home": reads[ready - 1]["home"]}
        state["clock"] = {"shown": clock.shown, "base": clock.base, "top": clock.top}
        return out, ready, state

    @staticmethod
    def _ready(readable: list[int], n: int) -> int:
        """How many reads at the front have all that they wait for."""
        for i in range(n):
            at = bisect_right(readable, i) + B.FOLLOWERS - 1
            if n - 1 - i < B.REACH and not (at < len(readable)):
                return i
        return n

    @staticmethod
    def _agree(reads, values, readable, i: int, speed: int) -> bool:
        """Whether the next readable reads agree with a clock that moves from this read's first value at this speed."""
        if not values[i]:
            return False
        at = bisect_right(readable, i)
        later = readable[at : at + B.FOLLOWERS]
        if len(later) < B.FOLLOWERS or later[-1] > i + B.REACH:
            return False
        first, t = values[i][0], reads[i]["t"]
        return all(any(abs(v - (first - speed * (reads[j]["t"] - t))) <= B.AGREE for v in values[j]) for j in later)


def clean_timeline_stream(reads: DataFrame, *, keys: list[str], ts: str, late: str = "10 seconds", idle: timedelta = timedelta(minutes=10), states: DataFrame | None = None) -> DataFrame:
    """scoreboard.clean_timeline over a stream of reads (keys, ts, t, clock, clock_text, away, home); states are a table.

    t must not fall as ts rises. Rows later than the watermark's delay are left out. A key without rows for `idle` has
    ended; rows that come for it after that begin it anew.
    """
    rows = B.with_places(reads, keys, states) if states is not None else reads.withColumn("known", F.lit(False)).withColumn("place", F.lit(None).cast("int"))
    pairs = F.to_json(F.transform(B.candidates(), lambda c: F.array(c["value"].cast("string"), c["text"])))
    rows = rows.select(*keys, ts, "t", pairs.alias("c"), F.col("away").cast("int").alias("away"), F.col("home").cast("int").alias("home"), "known", "place")
    return run_machine(rows, Scoreboard(keys, idle), keys=keys, ts=ts, late=late, out=B.CLEANED)


# --- intervals ----------------------------------------------------------------------------------------------------


class Plays(Ordered):
    """Cuts plays into intervals as they come: equal to states.intervals over all of a key's plays. A play waits for the
    next one and for the next that is no substitution or timeout; the first ones until both teams are known."""

    COLUMNS = "at long, seq long, clock double, team string, what string, made boolean, technical boolean, won boolean, steal boolean, ends_trip boolean, length double"
    FIELDS = ["team", "start_clock", "end_clock", "start_type", "full_court", "terminal", "free_throws", "events"]

    def __init__(self, keys: list[str], idle: timedelta):
        super().__init__(self.COLUMNS, ["seq"], idle)
        self.keys = keys

    def decide(self, key, rows, carried, final):
        state = carried or {"teams": [], "machine": None, "index": 0, "over": False}
        if state["over"]:
            return [], len(rows), state
        for r in rows:
            if r["team"] is not None and r["team"] not in state["teams"]:
                state["teams"].append(r["team"])
        ended = any(r["what"] == "end" for r in rows)
        if state["machine"] is None:
            if not rows or (len(state["teams"]) < 2 and not final and not ended):
                return [], 0, state
            machine = S.Intervals(state["teams"], rows[0]["length"])
        else:
            machine = S.Intervals.restored(state["machine"])
        done, following = 0, self._following(rows)
        for i, r in enumerate(rows):
            after, solid = rows[i + 1] if i + 1 < len(rows) else None, following[i]
            if not final and r["what"] != "end" and solid is None:
                break
            machine.play(self._play(r, after, solid))
            done = i + 1
            if r["what"] == "end":
                state["over"], done = True, len(rows)
                break
        out = []
        for found in machine.taken():
            out.append(Row(**dict(zip(self.keys, key, strict=True)), index=state["index"], **{f: found[f] for f in self.FIELDS}))
            state["index"] += 1
        state["machine"] = machine.saved()
        return out, done, state

    @staticmethod
    def _following(rows: list[dict]) -> list[dict | None]:
        """For each play the next one that is no substitution or timeout."""
        out, found = [], None
        for r in reversed(rows):
            out.append(found)
            found = found if r["what"] in ("substitution", "timeout") else r
        return out[::-1]

    @staticmethod
    def _play(r: dict, after: dict | None, solid: dict | None) -> dict:
        throw_next = solid is not None and solid["what"] == "free throw" and solid["clock"] == r["clock"]
        last = r["ends_trip"] if r["ends_trip"] is not None else not (throw_next and solid["team"] == r["team"])
        stolen = after is not None and after["steal"] and after["clock"] == r["clock"]
        return {k: r[k] for k in ("seq", "clock", "team", "what", "made", "technical", "won")} | {"last": last, "stolen": stolen, "shots": solid["team"] if throw_next else None}


def intervals_stream(plays: DataFrame, *, keys: list[str], ts: str, length: str | None = None, late: str = "10 seconds", idle: timedelta = timedelta(minutes=30)) -> DataFrame:
    """states.intervals over a stream of plays (keys, ts, seq, clock, team, type, text), of two teams a key: an interval
    comes out once it is closed. ts must not fall as seq rises; length as there. Late rows and keys as in
    clean_timeline_stream."""
    size = F.col(length).cast("double") if length else F.lit(1200.0)
    rows = S.play_facts(plays).select(*keys, ts, F.col("seq").cast("long").alias("seq"), F.col("clock").cast("double").alias("clock"), "team", "what", "made", "technical", "won", "steal", "ends_trip", size.alias("length"))
    return run_machine(rows, Plays(keys, idle), keys=keys, ts=ts, late=late, out=S.INTERVAL)


# --- runs ---------------------------------------------------------------------------------------------------------


class Runs(Ordered):
    """Counts a key's runs of equal labels; the count comes out when the key has ended."""

    def __init__(self, key: str, idle: timedelta):
        super().__init__("at long, label string", [], idle)
        self.key = key

    def decide(self, key, rows, carried, final):
        state = carried or {"runs": 0, "label": None}
        for r in rows:
            state = {"runs": state["runs"] + (state["runs"] == 0 or r["label"] != state["label"]), "label": r["label"]}
        out = [Row(**{self.key: key[0]}, runs=state["runs"])] if final else []
        return out, len(rows), state


def runs_of_labels(events: DataFrame, *, key: str, ts: str = "ts", label: str = "event_type", late: str = "1 hour", idle: timedelta = timedelta(days=60)) -> DataFrame:
    """(key, runs): how many runs of equal labels each key's events make in order of time, once it has ended."""
    return run_machine(events.select(key, ts, F.col(label).alias("label")), Runs(key, idle), keys=[key], ts=ts, late=late, out="runs long")
