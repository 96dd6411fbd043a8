"""A table kept as versions: each commit is whole or absent, and two writers of one version cannot both succeed.

Rows are written to a folder of their own first. A version becomes visible when its marker, a small file whose name is
the version and whose content names that folder, has been created; a file is created once only, so the second writer
gets a Conflict and works from the version that won. A crash on the way leaves a folder that nothing names, or an empty
marker, which readers skip and later versions pass over.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since the version that this commit builds on."""


class VersionedTable:
    """A versioned table at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        self._files = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> dict[int, int]:
        """Versions that were begun, with the sizes of their markers."""
        folder = self._at("versions")
        if not self._files.exists(folder):
            return {}
        found = {re.fullmatch(r"(\d+)", s.getPath().getName()): s.getLen() for s in self._files.listStatus(folder)}
        return {int(m[1]): size for m, size in found.items() if m}

    def versions(self) -> list[int]:
        """All committed versions, oldest first."""
        return sorted(v for v, size in self._markers().items() if size)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        return max(self.versions(), default=0)

    def facts(self, version: int | None = None) -> dict:
        """What the commit of a version noted: its folder, the version it builds on, its rows and the writer's notes."""
        stream = self._files.open(self._at(f"versions/{version or self.version():020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one by default."""
        if not (version or self.version()):
            raise FileNotFoundError(f"{self.path} has no version")
        facts = self.facts(version)
        return self.spark.read.schema(facts["schema"]).parquet(f"{self.path}/{facts['folder']}")

    def commit(self, rows: DataFrame, *, on: int | None = None, files: int | None = None, notes: dict | None = None) -> int:
        """Adds a version that holds just `rows` and gives its number. on: the version that the rows were made from
        (0: none); a Conflict if another was committed since. files: how many to write."""
        folder = f"rows-{uuid.uuid4().hex}"
        (rows.coalesce(files) if files else rows).write.parquet(f"{self.path}/{folder}")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        try:
            return self._mark({"folder": folder, "schema": kinds, "notes": notes or {}}, on)
        except Conflict:
            self._files.delete(self._at(folder), True)
            raise

    def _mark(self, facts: dict, on: int | None) -> int:
        """Creates the marker of the next version."""
        begun = self._markers()
        newest = max((v for v, size in begun.items() if size), default=0)
        if on is not None and newest != on:
            raise Conflict(f"{self.path} is at version {newest}, not {on}")
        version = max(begun, default=0) + 1
        try:
            stream = self._files.create(self._at(f"versions/{version:020d}"), False)
        except Exception as e:
            raise Conflict(f"version {version} of {self.path} was begun by another writer") from e
        try:
            stream.write(bytearray(json.dumps(facts | {"on": newest}).encode()))
        finally:
            stream.close()
        return version

    def relabel(self, version: int, notes: dict) -> int:
        """Adds a version of the same rows with other notes."""
        return self._mark(self.facts(version) | {"notes": notes}, version)

    def change(self, make: Callable[[DataFrame | None], DataFrame], *, attempts: int = 10, files: int | None = None, notes: dict | None = None) -> int:
        """Commits make(the newest rows, or None), again from the newer version where another writer came first."""
        for attempt in range(attempts):
            at = self.version()
            try:
                return self.commit(make(self.read(at) if at else None), on=at, files=files, notes=notes)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def upsert(self, rows: DataFrame, keys: list[str], merge: Callable[[DataFrame], DataFrame] | None = None, *, attempts: int = 10) -> int:
        """Puts rows in by key. A new row takes the place of the old one of its keys; with merge, which gets old and new
        rows together with a column _new and returns a row for each key, the two are combined. The keys of rows must be
        unique."""

        def put(old: DataFrame | None) -> DataFrame:
            if merge:
                both = rows.withColumn("_new", F.lit(True))
                return merge(both if old is None else old.withColumn("_new", F.lit(False)).unionByName(both))
            return rows if old is None else old.join(rows.select(*keys), keys, "left_anti").unionByName(rows)

        return self.change(put, attempts=attempts)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the rows of all but the `keep` newest versions, and folders that no version names. For times when
        nobody writes: the folder of a commit on its way is not named yet. Returns how many folders went."""
        every = self.versions()
        used = {self.facts(v)["folder"] for v in every[-keep:]}
        gone = [s.getPath() for s in self._files.listStatus(self._at("")) if s.getPath().getName().startswith("rows-") and s.getPath().getName() not in used]
        for path in gone:
            self._files.delete(path, True)
        for v in every[:-keep]:
            self._files.delete(self._at(f"versions/{v:020d}"), False)
        return len(gone)
