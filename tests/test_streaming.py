"""Streams over files: windows, lateness, early results, keyed state, jobs and snapshots."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater.functions import aggregates as A
from tidewater.operators import windows
from tidewater.plans.stage import Pipeline
from tidewater.sources import sinks, sources
from tidewater.streaming.jobs import JobConfig, Jobs


def put(folder, name, rows):
    """A file of (key, seconds) rows."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.writelines(json.dumps({"k": k, "s": s}) + "\n" for k, s in rows)


def events(spark, folder, lag=0):
    source = sources.files(folder).with_format("json", "k string, s long").build_watcher(max_files=1)
    return Pipeline(spark).read_from(source).with_timestamps("timestamp_seconds(s)", lag)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_windows_close_as_time_goes_on(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "1", [("a", 1), ("a", 2), ("b", 5)])
    stage = events(spark, folder).grouping_key("k").window(windows.tumbling(10_000)).aggregate(n=A.counting())
    rows = []
    take = lambda df, _: rows.extend((r.k, r.window_end.second, r.n) for r in df.collect())
    run = lambda: drain(sinks.start(stage.df, take, mode="append", checkpoint=str(tmp_path / "c")))
    run()
    assert rows == []
    put(folder, "2", [("a", 25)])
    run()
    assert sorted(rows) == [("a", 10, 2), ("b", 10, 1)]
    put(folder, "3", [("a", 3), ("a", 45)])  # the first is late, its window has gone
    run()
    assert sorted(rows) == [("a", 10, 2), ("a", 30, 1), ("b", 10, 1)]


def test_early_results_update(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "1", [("a", 1)])
    stage = events(spark, folder).grouping_key("k").window(windows.tumbling(10_000).with_early_results(100)).aggregate(n=A.counting())
    seen = []
    run = lambda: drain(sinks.start(stage.df, lambda df, _: seen.extend(r.n for r in df.collect()), mode="update", checkpoint=str(tmp_path / "c")))
    run()
    put(folder, "2", [("a", 2), ("a", 3)])
    run()
    assert seen == [1, 3]


def test_streams_refuse_what_groups_twice(spark, tmp_path):
    put(str(tmp_path / "in"), "1", [("a", 1)])
    stage = events(spark, str(tmp_path / "in")).grouping_key("k").window(windows.tumbling(10_000))
    with pytest.raises(ValueError, match="twice"):
        stage.aggregate(n=A.counting(), m=A.grouping_by("s"))


def test_early_and_final_results(spark, tmp_path):
    from tidewater.streaming.early import start_with_early_results

    folder = str(tmp_path / "in")
    put(folder, "1", [("a", 1)])
    stage = events(spark, folder).grouping_key("k").window(windows.tumbling(10_000).with_early_results(200)).aggregate(n=A.counting())
    seen = []
    with pytest.raises(ValueError):  # one query has one output mode
        stage.write_to(sinks.noop())
    queries = start_with_early_results(stage, lambda df: seen.extend((r.is_early, r.k, r.n) for r in df.collect()), str(tmp_path / "c"))
    try:
        for name, rows in (("2", [("a", 2)]), ("3", [("b", 30)])):
            queries.process_all()
            put(folder, name, rows)
        queries.process_all()
    finally:
        queries.stop()
    assert [x for x in seen if not x[0]] == [(False, "a", 2)]
    assert {(True, "a", 1), (True, "a", 2), (True, "b", 1)} <= set(seen)


def test_sessions_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "1", [("a", 1), ("a", 11), ("a", 13)])
    put(folder, "2", [("a", 100)])
    put(folder, "3", [("a", 200)])
    for k in (1, 2, 3):  # a stream takes files by their times, which may be equal here
        os.utime(f"{folder}/{k}", (1_700_000_000 + k, 1_700_000_000 + k))
    stage = events(spark, folder).grouping_key("k").window(windows.session(10_000)).aggregate(n=A.counting())
    rows = []
    drain(sinks.start(stage.df, lambda df, _: rows.extend((r.window_start.timestamp(), r.n) for r in df.collect()), mode="append", checkpoint=str(tmp_path / "c")))
    assert {(1, 1), (11, 2)} <= {(int(a), n) for a, n in rows}


def test_state_with_expiry(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    def step(state, key, row):
        state["n"] = state.get("n", 0) + 1
        return {"k": key[0], "what": "seen", "n": state["n"]}

    stage = events(spark, folder).grouping_key("k").map_stateful(dict, step, "k string, what string, n long", ttl_ms=20_000, on_evict=lambda s, k, t: {"k": k[0], "what": "gone", "n": s["n"]})
    rows = []
    for i, more in enumerate(([("a", 10), ("a", 11), ("b", 12)], [("c", 100)], [("c", 200)])):
        put(folder, str(i), more)
        drain(sinks.start(stage.df, lambda df, _: rows.extend(tuple(r) for r in df.collect()), mode="update", checkpoint=str(tmp_path / "c")))
    assert {("a", "seen", 1), ("a", "seen", 2), ("b", "seen", 1), ("a", "gone", 2), ("b", "gone", 1)} <= set(rows)


def test_stream_needs_timestamps(spark):
    s = Pipeline(spark).read_from(sources.item_stream(5))
    with pytest.raises(ValueError):
        s.without_timestamps().window(windows.tumbling(10))
    assert s.with_native_timestamps(5).df.isStreaming and s.with_ingestion_timestamps().ts == "event_time"
    with pytest.raises(ValueError):
        Pipeline(spark).read_from(sources.external("rate", stream=True)).with_native_timestamps()


def test_merge_enrich_and_map_sink(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "map")
    put(folder, "1", [("a", 1), ("b", 2)])
    table = spark.createDataFrame([("a", "A")], "key string, value string")
    stage = events(spark, folder).merge(events(spark, folder)).map_using_map(table, "k", "name").map(key="k", value="name")
    drain(stage.write_to(sinks.map_(out)))
    assert {tuple(r) for r in sinks.read_map(spark, out).collect()} == {("a", "A"), ("b", None)}


def test_file_sink_writes_once(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(folder, "1", [("a", 1)])
    write = lambda: drain(events(spark, folder).map("k").write_to(sinks.files(out).exactly_once(str(tmp_path / "c")).build()))
    write()
    write()
    assert [r.k for r in spark.read.json(out).collect()] == ["a"]


def test_journal_from_start_or_from_now(spark, tmp_path):
    import time

    folder = str(tmp_path / "in")
    put(folder, "1", [("a", 1)])
    time.sleep(1.1)
    read = lambda **o: Pipeline(spark).read_from(sources.journal(folder, "k string, s long", **o)).without_timestamps()
    every, late, few = read(), read(from_start=False), read(predicate="s > 1", projection=["k"])
    put(folder, "2", [("b", 2)])
    for stage, want in ((every, ["a", "b"]), (late, ["b"]), (few, ["b"])):
        rows = []
        drain(sinks.start(stage.df, lambda df, _, rows=rows: rows.extend(r.k for r in df.collect()), mode="append"))
        assert sorted(rows) == want


def test_custom_stream_source(spark, tmp_path):
    def fill(context, offset):
        at = offset["at"]
        return ([(i,) for i in range(at, min(at + 2, 4))], {"at": min(at + 2, 4)})

    stage = Pipeline(spark).read_from(sources.stream_from_builder("steps", "i int", dict, fill)).without_timestamps()
    rows = []
    query = stage.df.writeStream.foreachBatch(lambda df, _: rows.extend(r.i for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(rows) == [0, 1, 2, 3]


def test_jobs_and_snapshots(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(folder, "1", [("a", 1)])
    rows = []
    each = lambda df, _: rows.extend(r.k for r in df.collect())
    jobs = Jobs(spark)
    config = JobConfig("j1", str(tmp_path / "c"), "append")
    job = jobs.submit(config, lambda: events(spark, folder).map("k").df, each)
    with pytest.raises(ValueError):
        jobs.submit(config, lambda: None)
    assert jobs.submit_if_absent(config, lambda: None) is job and jobs.names() == ["j1"]
    job.query.processAllAvailable()
    job.suspend()
    assert job.status() == "SUSPENDED" and job.suspension_cause() == "requested"
    put(folder, "2", [("b", 2)])
    job.resume()
    job.query.processAllAvailable()
    assert rows == ["a", "b"] and job.metrics()["name"] == "j1"
    job.export_snapshot(str(tmp_path / "snap"))
    job.restart()
    job.cancel()
    assert job.status() == "CANCELLED" and jobs.names() == []
    put(folder, "3", [("c", 3)])
    again = jobs.submit(JobConfig("j2", str(tmp_path / "c2"), initial_snapshot=str(tmp_path / "snap"), available_now=True), lambda: events(spark, folder).map("k").df, each)
    assert again.join(120) and again.status() == "COMPLETED" and rows == ["a", "b", "c"]
    with pytest.raises(KeyError):
        jobs.get("none")


def test_sql_jobs(spark, tmp_path):
    from tidewater.sql.engine import SqlEngine

    sql = SqlEngine(spark, checkpoints=str(tmp_path / "jobs"))
    sql.execute(f"CREATE MAPPING out (v BIGINT) TYPE FOLDER OPTIONS ('path' = '{tmp_path}/out')")
    sql.execute("CREATE JOB j OPTIONS ('processingGuarantee' = 'exactlyOnce') AS INSERT INTO out SELECT v FROM TABLE(GENERATE_STREAM(10))")
    sql.execute("CREATE JOB IF NOT EXISTS j AS INSERT INTO out SELECT v FROM TABLE(GENERATE_STREAM(10))")
    assert [r.name for r in sql.execute("SHOW JOBS").collect()] == ["j"]
    sql.execute("ALTER JOB j SUSPEND")
    sql.execute("ALTER JOB j RESUME")
    sql.execute("ALTER JOB j RESTART")
    sql.execute("CREATE OR REPLACE SNAPSHOT s FOR JOB j")
    sql.execute("DROP SNAPSHOT s")
    sql.execute("DROP JOB j WITH SNAPSHOT s2")
    sql.execute("DROP JOB IF EXISTS j")
    assert sql.execute("SHOW JOBS").count() == 0 and "s2" in sql.snapshots
    assert F is not None


def test_watchers_see_appended_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("one\ntwo\nhalf")
    seen = []
    df = Pipeline(spark).read_from(sources.file_watcher(str(folder), "*.log")).df
    run = lambda: drain(sinks.start(df, lambda d, _: seen.extend((r.file_name, r.value) for r in d.collect()), checkpoint=str(tmp_path / "c")))
    run()
    with open(folder / "a.log", "a") as f:
        f.write(" a line\nthree\n")
    (folder / "b.log").write_text("new\r\n")
    (folder / "c.txt").write_text("not ours\n")
    run()
    assert sorted(seen) == [("a.log", "half a line"), ("a.log", "one"), ("a.log", "three"), ("a.log", "two"), ("b.log", "new")]
    (folder / "d.json").write_text('{"k": "x", "s": 3}\n')
    got = []
    docs = Pipeline(spark).read_from(sources.json_watcher(str(folder), "k string, s long", "*.json")).df
    drain(sinks.start(docs, lambda d, _: got.extend(map(tuple, d.collect())), checkpoint=str(tmp_path / "c2")))
    assert got == [("x", 3)]


def test_line_ends_are_found_backwards(tmp_path):
    from tidewater.sources.tail import last_line_end

    path = tmp_path / "x"
    path.write_bytes(b"ab\ncd\nefghij")
    assert [last_line_end(str(path), low, 13, step) for low in (0, 3, 7) for step in (2, 100)] == [6, 6, 6, 6, 7, 7]
