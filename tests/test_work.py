"""Chunks that resume, the status of games, and graphs of stored tables."""

import threading

import pytest
from pyspark.sql import functions as F

from tracklens.plans import graph as G
from tracklens.plans.graph import JobGraph, Step
from tracklens.sources.chunks import ChunkStore
from tracklens.sources.status import StatusTable
from tracklens.streaming.events import event_stream


def frames(spark, chunks=6, each=20):
    return spark.range(chunks * each).select(F.col("id").alias("frame"), F.floor(F.col("id") / each).cast("int").alias("chunk"))


def test_a_killed_run_and_its_rerun_give_each_frame_once(spark, tmp_path):
    store, seen = ChunkStore(spark, str(tmp_path / "c")), []

    def dies(rows):
        names = sorted(r["chunk"] for r in rows.select("chunk").distinct().collect())
        seen.append(names)
        if "4" in names:  # dies after some of the rows of the chunk have been written
            rows.filter("frame % 2 = 0").write.parquet(f"{store.path}/rows-{'0' * 32}")
            raise RuntimeError("killed")
        return rows.withColumn("twice", F.col("frame") * 2)

    with pytest.raises(RuntimeError):
        store.run(frames(spark), dies, at_once=2)
    assert seen == [["0", "1"], ["2", "3"], ["4", "5"]] and store.done().count() == 4
    assert ChunkStore(spark, store.path).run(frames(spark), lambda r: r.withColumn("twice", F.col("frame") * 2)) == ["4", "5"]
    rows = store.read("frame long, twice long").collect()
    assert sorted(r["frame"] for r in rows) == list(range(120)) and all(r["twice"] == 2 * r["frame"] and r["chunk"] == str(r["frame"] // 20) for r in rows)
    assert store.run(frames(spark), dies) == []
    assert store.run(frames(spark), lambda r: r.withColumn("twice", F.lit(0).cast("long")), force=["3"]) == ["3"]
    assert sorted(r["frame"] for r in store.read("frame long, twice long").filter("twice = 0 and frame > 0").collect()) == list(range(60, 80))


def test_two_runs_at_once_do_not_double_rows(spark, tmp_path):
    path, errors = str(tmp_path / "c"), []

    def work():
        try:
            ChunkStore(spark, path).run(frames(spark, 3), lambda r: r, at_once=1)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted(r["frame"] for r in ChunkStore(spark, path).read("frame long").collect()) == list(range(60))


def test_a_batch_that_is_handed_out_again_is_written_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "out"))
    source = str(tmp_path / "in")
    frames(spark, 2).write.parquet(source)
    fail = [True]
    inner = store.sink()

    def write(batch, number):
        inner(batch, number)
        if fail[0]:
            raise RuntimeError("after the write, before the batch is committed")

    def start():
        stream = event_stream(spark, source, "frame long, chunk int").drop("chunk")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="before the batch is committed"):
        start()
    fail[0] = False
    start()
    frames(spark, 3).filter("chunk = 2").write.mode("append").parquet(source)
    start()
    assert sorted(r["frame"] for r in store.read("frame long").collect()) == list(range(60))
    assert store.done().count() == 2


def test_status_keeps_costs_and_attempts(spark, tmp_path):
    t = StatusTable(spark, str(tmp_path / "s"))
    kind = "game string, at long, status string, home_check string, returncode string, seconds int, cost double"
    add = lambda *rows: t.record(spark.createDataFrame([*rows], kind))
    assert t.read().count() == 0 and t.spent() == 0.0
    add(("a", 1, "failed", "ok", "1", 30, 2.5), ("b", 1, None, "mismatch", None, None, None))
    add(("a", 2, "done", None, "0", 40, None))
    rows = {r["game"]: r for r in t.read().collect()}
    assert rows["a"]["status"] == "done" and rows["a"]["cost"] == 2.5 and rows["a"]["home_check"] == "ok"
    assert [(x["returncode"], x["seconds"], x["cost"]) for x in rows["a"]["attempts"]] == [("1", 30, 2.5), ("0", 40, None)]
    assert rows["b"]["attempts"] == [] and t.spent() == 2.5
    add(("a", 3, "done", None, "0", 10, 1.0))
    assert t.spent() == 3.5
    games = spark.createDataFrame([(g,) for g in "abc"], "game string")
    assert [r["game"] for r in t.todo(games).collect()] == ["c"]
    assert {r["game"] for r in t.todo(games, again=True).collect()} == {"a", "c"}


def test_of_two_who_record_at_once_no_attempt_is_lost(spark, tmp_path):
    path, errors = str(tmp_path / "s"), []

    def work(name):
        try:
            for k in range(2):
                row = spark.createDataFrame([("g", k, name, None, name, 1, 1.0)], "game string, at long, status string, home_check string, returncode string, seconds int, cost double")
                StatusTable(spark, path).record(row)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in "xy"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted((a["returncode"], a["at"]) for a in StatusTable(spark, path).read().first()["attempts"]) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]


# --- graphs -------------------------------------------------------------------------------------------------------


def test_fingerprints_see_rows_not_their_order(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None), (2, None, None)], "x int, s string, m map<string,int>")
    assert G.fingerprint(df) == G.fingerprint(df.orderBy(F.desc("x")).repartition(3))
    assert len({G.fingerprint(d) for d in (df, df.dropDuplicates(["x"]), df.fillna("", ["s"]), df.withColumn("x", F.col("x").cast("long")), df.withColumnRenamed("s", "r"))}) == 5


def steps(log, version="1", fail=()):
    def note(name, make):
        def run(t):
            log.append(name)
            if name in fail:
                raise RuntimeError(name)
            return make(t)

        return run

    return [
        Step("page", ("sums", "names"), ("page",), note("page", lambda t: {"page": t["sums"].join(t["names"], "k")})),
        Step("clean", ("raw",), ("even", "odd"), note("clean", lambda t: {"even": t["raw"].filter("v % 2 = 0"), "odd": t["raw"].filter("v % 2 = 1")})),
        Step("sum", ("even",), ("sums",), note("sum", lambda t: {"sums": t["even"].groupBy("k").agg(F.sum("v").alias("v"))}), version),
    ]


def test_only_what_a_change_reaches_runs_again(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1), ("a", 2), ("b", 4)], "k string, v int")
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bo")], "k string, name string")
    log = []
    graph = JobGraph(spark, str(tmp_path / "g"), steps(log))
    assert graph.run({"raw": raw, "names": names}, dry=True).ran == ["clean", "sum", "page"] and log == []
    assert graph.run({"raw": raw, "names": names}).ran == ["clean", "sum", "page"] == log
    assert sorted(tuple(r) for r in graph.read("page").select("k", "v", "name").collect()) == [("a", 2, "Ann"), ("b", 4, "Bo")]
    log.clear()
    report = graph.run({"raw": raw.orderBy("v"), "names": names})
    assert report.ran == log == [] and report.fresh == ["clean", "sum", "page"]
    assert graph.run({"raw": raw, "names": names.filter("k = 'a'")}).ran == ["page"]
    assert graph.read("page").count() == 1
    # An odd value more changes clean's outputs, but not the one that sum reads.
    more = raw.unionByName(spark.createDataFrame([("b", 7)], "k string, v int"))
    report = graph.run({"raw": more, "names": names.filter("k = 'a'")})
    assert report.ran == ["clean"] and report.fresh == ["sum", "page"]
    log.clear()
    newer = JobGraph(spark, str(tmp_path / "g"), steps(log, version="2"))
    assert newer.run({"raw": more, "names": names.filter("k = 'a'")}).ran == ["sum"]  # its result is the same, so page is fresh
    assert newer.run({"raw": more, "names": names.filter("k = 'a'")}, force=["clean"], dry=True).ran == ["clean", "sum", "page"]
    assert newer.run({"raw": more, "names": names}, only=["sum"]).ran == []


def test_a_failing_step_leaves_the_old_tables_and_blocks_what_follows(spark, tmp_path):
    raw = spark.createDataFrame([("a", 2)], "k string, v int")
    names = spark.createDataFrame([("a", "Ann")], "k string, name string")
    JobGraph(spark, str(tmp_path / "g"), steps([])).run({"raw": raw, "names": names})
    graph = JobGraph(spark, str(tmp_path / "g"), steps([], fail=("sum",)))
    changed = raw.withColumn("v", F.lit(8))
    report = graph.run({"raw": changed, "names": names}, keep_going=True)
    assert report.ran == ["clean"] and list(report.failed) == ["sum"] and report.blocked == ["page"]
    assert graph.read("page").first()["v"] == 2
    with pytest.raises(RuntimeError):
        graph.run({"raw": changed, "names": names})
    assert JobGraph(spark, str(tmp_path / "g"), steps([])).run({"raw": changed, "names": names}).ran == ["sum", "page"]


def test_graphs_that_cannot_be(spark, tmp_path):
    nothing = lambda t: {}
    with pytest.raises(ValueError, match="circle"):
        JobGraph(spark, "x", [Step("a", ("q",), ("p",), nothing), Step("b", ("p",), ("q",), nothing)])
    with pytest.raises(ValueError, match="made by"):
        JobGraph(spark, "x", [Step("a", (), ("p",), nothing), Step("b", (), ("p",), nothing)])
    with pytest.raises(KeyError):
        JobGraph(spark, str(tmp_path), [Step("a", ("missing",), ("p",), nothing)]).run({})
    with pytest.raises(ValueError, match="gives"):
        JobGraph(spark, str(tmp_path), [Step("a", (), ("p",), nothing)]).run({})
