"""Jobs as a graph of stored tables that know what they were made from.

Every step's outputs are versioned tables. A commit notes the fingerprints of the step's inputs and the step's own
version; a step runs where these differ from what its newest commit notes, or where it has none. The fingerprint of a
table is of its rows whatever their order, so a source that changes reruns only the steps that read it, and steps behind
one whose output came out the same do not run at all. A step that fails leaves what it had made before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable


@dataclass(frozen=True)
class Step:
    """make gets the tables that the step reads, by name, and gives its outputs by name. version changes with its code."""

    name: str
    reads: tuple[str, ...]
    gives: tuple[str, ...]
    make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
    version: str = "1"


def fingerprint(df: DataFrame) -> str:
    """Of the columns and rows of a table, in any order; rows that repeat count. One aggregate, of 64-bit hashes in two
    independent sums."""
    columns = sorted(df.columns)
    # Maps have no order of their own and no hash; they count as sorted entries.
    plain = [F.array_sort(F.map_entries(c)) if dict(df.dtypes)[c].startswith("map") else F.col(f"`{c}`") for c in columns]
    marked = [x for c in plain for x in (c.isNull(), c)]
    h, g = F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)
    r = df.select(h.alias("h"), g.alias("g")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("a"), F.sum(F.col("g").cast("decimal(20,0)")).alias("b"), F.bit_xor("h").alias("c")).first()
    kinds = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in columns)
    return f"{kinds}|{r['n']}|{r['a']}|{r['b']}|{r['c']}"


@dataclass
class Report:
    """What a run did."""

    ran: list[str] = field(default_factory=list)
    fresh: list[str] = field(default_factory=list)  # nothing had changed
    failed: dict[str, Exception] = field(default_factory=dict)
    blocked: list[str] = field(default_factory=list)  # a step before failed


class JobGraph:
    """Steps over source tables, with their outputs stored at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, steps: list[Step]):
        self.spark, self.path, self.steps = spark, path.rstrip("/"), self._ordered(steps)
        self.giver = {t: s for s in self.steps for t in s.gives}

    @staticmethod
    def _ordered(steps: list[Step]) -> list[Step]:
        """Steps after those whose outputs they read; two givers of a table, or a circle, are a ValueError."""
        giver: dict[str, Step] = {}
        for s in steps:
            for t in s.gives:
                if t in giver:
                    raise ValueError(f"{t} is made by {giver[t].name} and {s.name}")
                giver[t] = s
        out: list[Step] = []
        waiting = list(steps)
        while waiting:
            ready = [s for s in waiting if all(t not in giver or giver[t] in out for t in s.reads)]
            if not ready:
                raise ValueError(f"steps in a circle: {', '.join(s.name for s in waiting)}")
            out += ready
            waiting = [s for s in waiting if s not in ready]
        return out

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.table(name).read()

    def _print_of(self, name: str) -> str | None:
        t = self.table(name)
        return t.facts()["notes"].get("fingerprint") if t.version() else None

    def run(self, sources: dict[str, DataFrame], *, force: list[str] = (), only: list[str] | None = None, dry: bool = False, keep_going: bool = False) -> Report:
        """Runs the steps whose inputs or versions have changed, and those in force. only: these steps alone. dry: says
        what would run as far as it can tell (a step counts as changed if one that it reads from would run).
        keep_going: a failing step does not end the run, only what depends on it."""
        unknown = {t for s in self.steps for t in s.reads} - set(sources) - set(self.giver)
        if unknown:
            raise KeyError(f"no table {', '.join(sorted(unknown))}")
        read = {t for s in self.steps for t in s.reads}
        prints = {t: fingerprint(df) for t, df in sources.items() if t in read}
        report, moved = Report(), set()
        for step in self.steps:
            if only is not None and step.name not in only:
                continue
            before = [self.giver[t] for t in step.reads if t in self.giver]
            if any(s.name in report.failed or s.name in report.blocked for s in before):
                report.blocked.append(step.name)
                continue
            wanted = {"inputs": {t: prints[t] if t in prints else self._print_of(t) for t in step.reads}, "step": f"{step.name} {step.version}"}
            stored = [self.table(t) for t in step.gives]
            current = all(v.version() and {k: v.facts()["notes"].get(k) for k in wanted} == wanted for v in stored)
            if current and step.name not in force and not (dry and any(s.name in moved for s in before)):
                report.fresh.append(step.name)
                continue
            moved.add(step.name)
            report.ran.append(step.name)
            if not dry:
                try:
                    self._make(step, sources, wanted)
                except Exception as e:
                    if not keep_going:
                        raise
                    report.ran.remove(step.name)
                    report.failed[step.name] = e
        return report

    def _make(self, step: Step, sources: dict[str, DataFrame], wanted: dict) -> None:
        made = step.make({t: sources[t] if t in sources else self.read(t) for t in step.reads})
        if set(made) != set(step.gives):
            raise ValueError(f"{step.name} gives {sorted(made)}, not {sorted(step.gives)}")
        for name, df in made.items():
            t = self.table(name)
            # Written first without a fingerprint, which is taken from the stored rows; the version that counts notes it.
            folder_version = t.commit(df, notes={})
            t.relabel(folder_version, wanted | {"fingerprint": fingerprint(t.read(folder_version))})
