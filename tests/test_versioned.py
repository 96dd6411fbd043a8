"""Versioned tables: commits are whole, conflicts are seen, nothing of two writers is lost."""

import threading

import pytest

from tracklens.sources.versioned import Conflict, VersionedTable


def rows(spark, *pairs):
    return spark.createDataFrame([*pairs], "game string, attempts int")


def found(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_versions_and_upserts(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "status"))
    assert t.version() == 0 and t.versions() == []
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.upsert(rows(spark, ("a", 1), ("b", 1)), ["game"]) == 1
    assert t.upsert(rows(spark, ("b", 2), ("c", 1)), ["game"]) == 2
    assert found(t) == [("a", 1), ("b", 2), ("c", 1)] and found(t, 1) == [("a", 1), ("b", 1)]
    assert t.facts(2)["on"] == 1
    add = lambda both: both.groupBy("game").agg({"attempts": "sum"}).toDF("game", "attempts").selectExpr("game", "cast(attempts as int) attempts")
    t.upsert(rows(spark, ("a", 5)), ["game"], add)
    assert found(t) == [("a", 6), ("b", 2), ("c", 1)]
    assert t.vacuum(keep=1) == 2 and t.versions() == [3] and found(t) == [("a", 6), ("b", 2), ("c", 1)]


def test_a_commit_on_an_old_version_fails_and_leaves_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(rows(spark, ("a", 1)), on=0)
    with pytest.raises(Conflict):
        t.commit(rows(spark, ("a", 2)), on=0)
    assert found(t) == [("a", 1)] and len(list((tmp_path / "t").glob("rows-*"))) == 1


def test_crashes_leave_the_old_version_readable(spark, tmp_path):
    """Rows without a marker, and a marker without content."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(rows(spark, ("a", 1)))
    rows(spark, ("half", 0)).write.parquet(str(tmp_path / "t" / "rows-half"))
    (tmp_path / "t" / "versions" / f"{2:020d}").touch()
    assert found(t) == [("a", 1)] and t.version() == 1
    assert t.upsert(rows(spark, ("b", 1)), ["game"]) == 3
    assert found(t) == [("a", 1), ("b", 1)]
    assert t.vacuum(keep=1) == 2


def test_of_two_writers_neither_is_lost(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    errors = []

    def write(name):
        try:
            for k in range(3):
                VersionedTable(spark, t.path).upsert(rows(spark, (f"{name}{k}", k)), ["game"], attempts=30)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors
    assert found(t) == [(f"{n}{k}", k) for n in "xy" for k in range(3)]
    assert [t.facts(v)["on"] for v in t.versions()] == [0, *t.versions()[:-1]]


def test_only_one_of_those_who_begin_together_commits(spark, tmp_path, monkeypatch):
    """Both see the same version when they choose their number; the marker is made once."""
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.commit(rows(spark, ("a", 1)))
    monkeypatch.setattr(b, "_markers", lambda: {1: 1})
    a.commit(rows(spark, ("a", 2)), on=1)
    with pytest.raises(Conflict):
        b.commit(rows(spark, ("b", 1)), on=1)
    assert found(a) == [("a", 2)]
