"""Stage semantics that the queries don't show: empty inputs, nulls, ties, refusals."""

import math

import pytest
from pyspark.sql import functions as F

from tidewater.functions import aggregates as A
from tidewater.operators import traverse, windows
from tidewater.operators.joins import BROADCAST_BYTES, on_keys, plan_bytes
from tidewater.plans.stage import Pipeline, Stage
from tidewater.sources import cdc, sinks, sources


def stage(spark, rows, schema, ts=None):
    return Stage(spark.createDataFrame(rows, schema), ts)


def test_empty_results_of_each_operation(spark):
    none = stage(spark, [], "k string, x long, y double")
    got = none.aggregate(n=A.counting(), s=A.summing_long("x"), d=A.summing_double("y"), a=A.averaging_double("y"), t=A.linear_trend("x", "y"), l=A.to_list("x"), c=A.concatenating("k", ",", "<", ">")).collect()
    assert len(got) == 1 and (got[0].n, got[0].s, got[0].d, got[0].l, got[0].c) == (0, 0, 0.0, [], "<>")
    assert math.isnan(got[0].a) and math.isnan(got[0].t)
    for op in (A.min_by("x", "y"), A.max_by("x", "y"), A.pick_any("x")):
        assert none.aggregate(op).collect() == []
    assert none.grouping_key("k").aggregate(A.counting()).collect() == []


def test_max_by_keeps_the_first_of_equals(spark):
    s = stage(spark, [(1, "a", 5), (2, "b", 5), (3, "c", 1)], "i int, x string, v int")
    assert s.aggregate(A.max_by("x", "v", "i")).collect()[0].result == "a"
    assert s.aggregate(A.max_by(["i", "x"], "v", "i")).collect()[0].result.x == "a"


def test_items_by_one_key_with_nulls(spark):
    """A null key is less than all others, a null item is an item; the same under a guard, and over frames of rows."""
    rows = [("a", 1, None), ("a", 2, 5.0), ("a", 3, 7.0), ("b", 4, None), ("c", None, 9.0), ("c", 5, 1.0), ("d", 6, 2.0), ("e", 7, float("nan")), ("e", 8, 3.0)]
    s = stage(spark, rows, "k string, i int, v double")
    ops = {"most": A.max_by("i", "v"), "least": A.min_by("i", "v"), "small": A.filtering("v < 6", A.max_by("i", "v")), "few": A.filtering("i <> 1", A.min_by("i", "v"))}
    got = {r.k: (r.most, r.least, r.small, r.few) for r in s.grouping_key("k").aggregate(**ops).collect()}
    assert got == {"a": (3, 1, 2, 2), "b": (4, 4, None, 4), "c": (None, 5, 5, 5), "d": (6, 6, 6, 6), "e": (7, 8, 8, 8)}
    last = s.grouping_key("k").rolling_aggregate(F.expr("coalesce(i, 99)"), **ops).df.where("coalesce(i, 99) IN (3, 4, 99, 6, 8)").collect()
    assert {r.k: (r.most, r.least, r.small, r.few) for r in last} == got | {"c": (None, 5, 5, 5)}
    assert s.filter("k = 'b'").aggregate(A.max_by("i", "v")).collect()[0].result == 4
    assert s.filter("k = 'b'").aggregate(A.filtering("v > 0", A.min_by("i", "v"))).collect() == []


def test_overflow_and_duplicate_keys_raise(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        stage(spark, [(2**62,), (2**62,)], "x long").aggregate(A.summing_long("x")).collect()
    with pytest.raises(PySparkException):
        stage(spark, [(1, "a"), (1, "b")], "k int, v string").aggregate(A.to_map("k", "v")).collect()


def test_null_keys(spark):
    from pyspark.errors import PySparkException

    s = stage(spark, [(None, 1), (None, 2), ("a", 3)], "k string, x int")
    assert {(r.k, r.result) for r in s.grouping_key("k").aggregate(A.counting()).collect()} == {(None, 2), ("a", 1)}
    with pytest.raises(PySparkException):
        s.grouping_key("k", strict=True).aggregate(A.counting()).collect()
    both = s.grouping_key("k").aggregate2(A.counting(), s.filter("x > 1").grouping_key("k"), A.summing_long("x"))
    assert {tuple(r) for r in both.collect()} == {(None, 2, 2), ("a", 1, 3)}


def test_concatenating_skips_empty_texts(spark):
    s = stage(spark, [(1, "a"), (2, ""), (3, "b")], "i int, x string")
    assert s.aggregate(A.concatenating("x", "-", order="i")).collect()[0].result == "a-b"


def test_mapping_skips_nulls(spark):
    s = stage(spark, [(1,), (2,), (3,)], "x int")
    op = A.mapping(lambda x: F.when(x > 1, x), lambda v: A.to_list(v), "x")
    assert sorted(s.aggregate(op).collect()[0].result) == [2, 3]
    assert s.aggregate(A.filtering("x > 5", A.counting())).collect()[0].result == 0


def test_all_of_builder_and_refusals():
    b = A.AllOfBuilder()
    b.add("n", A.counting())
    assert b.build()
    with pytest.raises(ValueError):
        A.all_of(m=A.grouping_by("k"))
    with pytest.raises(ValueError):
        A.with_create(list).and_export_finish(len, "int")


def test_custom_without_combine_sees_all_rows(spark):
    op = A.with_create(list).and_accumulate(lambda a, r: [*a, r["x"]]).and_export_finish(lambda a: sum(a), "long")
    s = stage(spark, [("a", 1), ("a", 2), ("b", 5)], "k string, x long")
    assert {tuple(r) for r in s.grouping_key("k").aggregate(op).collect()} == {("a", 3), ("b", 5)}


def test_reducing_in_order(spark):
    s = stage(spark, [(2, "b"), (1, "a"), (3, "c")], "i int, x string")
    assert s.aggregate(A.reducing(F.lit(""), "x", lambda a, x: F.concat(a, x), order="i")).collect()[0].result == "abc"


def test_traverser_combinators(spark):
    s = spark.createDataFrame([([1, 2, 3, 4, 1],), ([],), ([5],)], "a array<int>")
    a = F.col("a")
    got = s.select(
        traverse.take_while(a, lambda x: x < 3).alias("t"), traverse.drop_while(a, lambda x: x < 3).alias("d"),
        traverse.append(traverse.prepend(a, F.lit(0)), F.lit(9)).alias("p"), traverse.flat_map_items(a, lambda x: F.array(x, x)).alias("f"),
        traverse.map_items(a, lambda x: F.when(x > 2, x * 10)).alias("m"), traverse.filter_items(a, lambda x: x == 1).alias("k"),
    ).collect()
    assert (got[0].t, got[0].d, got[0].p, got[0].m, got[0].k) == ([1, 2], [3, 4, 1], [0, 1, 2, 3, 4, 1, 9], [30, 40], [1, 1])
    assert got[0].f[:4] == [1, 1, 2, 2]
    assert (got[1].t, got[1].d, got[2].t, got[2].d) == ([], [], [], [5])


def test_rows_services_and_transforms(spark):
    s = stage(spark, [(1, "a"), (2, None)], "i int, x string")
    assert [tuple(r) for r in s.map_rows(lambda r: {"i": r["i"] * 2} if r["x"] else None, "i int").collect()] == [(2,)]
    assert s.flat_map_rows(lambda r: [{"j": 1}] * r["i"], "j int").df.count() == 3
    assert s.custom_transform(lambda df: df.where("i > 1")).df.count() == 1
    assert s.apply(lambda t: t.filter("x IS NULL")).df.count() == 1
    assert s.rebalance(parallelism=3).df.rdd.getNumPartitions() == 3
    assert s.peek("p", "i > 1").set_name("n").set_local_parallelism(1).df.count() == 2
    assert s.sort("i").collect()[0].i == 1 and s.merge(s, s).distinct().df.count() == 2
    assert s.grouping_key("x").custom_transform(lambda g: g.head(1), "i int, x string").df.count() == 2


def test_sessions_that_touch_stay_apart(spark):
    s = stage(spark, [("a", 0), ("a", 10), ("a", 15)], "k string, ms long").add_timestamps("timestamp_millis(ms)")
    got = s.grouping_key("k").window(windows.session(10)).aggregate(A.counting()).map(a="unix_millis(window_start)", b="unix_millis(window_end)", n="result").collect()
    assert sorted(tuple(r) for r in got) == [(0, 10, 1), (10, 25, 2)]


def test_windows_refuse(spark):
    with pytest.raises(ValueError):
        windows.sliding(10, 3)
    with pytest.raises(ValueError):
        stage(spark, [(1,)], "x int").window(windows.tumbling(10))
    with pytest.raises(ValueError):
        stage(spark, [(1,)], "x int").rolling_aggregate(n=A.counting())


def test_keyed_windowed_distinct_and_builder(spark):
    s = stage(spark, [("a", 1), ("a", 2), ("b", 3), ("a", 12)], "k string, ms long").add_timestamps("timestamp_millis(ms)")
    w = s.grouping_key("k").window(windows.tumbling(10))
    assert w.distinct().df.count() == 3
    b = w.aggregate_builder(A.counting())
    b.add("other", s.filter("k = 'a'").grouping_key("k").window(windows.tumbling(10)), A.summing_long("ms"))
    assert sorted((r.k, r.f0, r.other) for r in b.build().collect()) == [("a", 1, 12), ("a", 2, 3), ("b", 1, 0)]
    both = A.aggregate_operation2(A.counting(), A.summing_long("ms"))
    got = w.co_aggregate(both, w).collect()
    assert sorted((r.k, r.result.f0, r.result.f1) for r in got) == [("a", 1, 12), ("a", 2, 3), ("b", 1, 3)]


def test_large_sides_are_not_broadcast(spark):
    big = spark.range(20_000_000).selectExpr("id AS k", "id AS v")
    assert plan_bytes(big) > BROADCAST_BYTES
    joined = stage(spark, [(1,)], "k long").hash_join(Stage(big), on_keys("k", "k")).df
    assert "BroadcastHint" not in joined._jdf.queryExecution().analyzed().toString() and "strategy=broadcast" not in joined._jdf.queryExecution().analyzed().toString()


# -- sources and sinks


def test_file_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\ny\n")
    (tmp_path / "b.csv").write_text("name,n\nz,3,extra\n")
    (tmp_path / "c.jsonl").write_text('{"name": "x", "n": 1, "o": {"p": 1}}\n{"name": "y"}\n')
    p = Pipeline(spark)
    csv = p.read_from(sources.files(str(tmp_path)).with_format("csv", "name string, n int").with_glob("*.csv").with_file_name().build())
    assert {(r.name, r.n, r.file_name) for r in csv.collect()} == {("x", 1, "a.csv"), ("y", None, "a.csv"), ("z", 3, "b.csv")}
    got = p.read_from(sources.json(str(tmp_path / "c.jsonl"))).collect()
    assert {(r.name, r.n, r.o) for r in got} == {("x", 1.0, '{"p":1}'), ("y", None, None)}
    assert p.read_from(sources.files(str(tmp_path / "a.csv")).build()).df.count() == 3
    assert p.read_from(sources.files(str(tmp_path / "a.csv")).with_format("text").build()).df.count() == 1
    assert p.read_from(sources.files(str(tmp_path / "a.csv")).with_format("bytes").build()).collect()[0].content == (tmp_path / "a.csv").read_bytes()
    assert p.read_from(sources.files(str(tmp_path / "none")).ignore_file_not_found().build()).df.count() == 0
    with pytest.raises(ValueError):
        sources.files("x").with_format("xml")


def test_items_lists_and_builders(spark):
    p = Pipeline(spark, preserve_order=True)
    assert p.read_from(sources.items([1, 2], "x int")).df.columns == ["x", "source_order"]
    assert [tuple(r) for r in sources.list_(["a", "b"], "x string").read(spark).collect()] == [(0, "a"), (1, "b")]
    assert sources.items_distributed([1], [2, 3], schema="x int").read(spark).count() == 3
    made = sources.from_builder("counted", "i int", lambda o: o, lambda o: iter([(o["partition"],), (o["partitions"],)]), partitions=2)
    assert sorted(r.i for r in made.read(spark).collect()) == [0, 1, 2, 2]
    spark.createDataFrame([(1, "a", 2.0)], "k int, v string, w double").createOrReplaceTempView("t_map")
    assert sources.table("t_map", "k = 1", ["v"]).read(spark).collect()[0].v == "a"
    assert sources.entries("t_map", "k", ["v", "w"]).read(spark).collect()[0].value.w == 2.0


def test_map_sinks(spark, tmp_path):
    path = str(tmp_path / "m")
    put = lambda rows, sink, schema="key string, value long": stage(spark, rows, schema).write_to(sink)
    now = lambda: {r["key"]: r["value"] for r in sinks.read_map(spark, path).collect()}
    put([("a", 1), ("b", 2)], sinks.map_(path))
    put([("b", 3), ("c", 4)], sinks.map_(path))
    assert now() == {"a": 1, "b": 3, "c": 4}
    put([("a", 10), ("d", 5)], sinks.map_with_merging(path, lambda old, new: old + new))
    assert now() == {"a": 11, "b": 3, "c": 4, "d": 5}
    put([("a", None)], sinks.map_with_merging(path, lambda old, new: F.lit(None).cast("long")))
    assert now() == {"b": 3, "c": 4, "d": 5}
    put([("b", 1), ("b", 1), ("e", 7), ("c", -1)], sinks.map_with_updating(path, lambda old, row: None if row["value"] < 0 else (old or 0) + row["value"], "key string, value long"))
    assert now() == {"b": 5, "d": 5, "e": 7}


def test_changes_become_a_map(spark, tmp_path):
    row = lambda op, k, v, pos: (f'{{"id": {k}}}', f'{{"op": "{op}", "ts_ms": 1, "after": {{"id": {k}, "name": "{v}"}}, "source": {{"pos": {pos}, "file": "f"}}}}')
    df = spark.createDataFrame([row("c", 1, "a", 1), row("u", 1, "b", 3), row("u", 1, "old", 2), row("c", 2, "x", 4), row("d", 2, "x", 5)], "key string, value string")
    changes = cdc.parse_changes(df, "id int, name string", key_schema="id int")
    assert [(r.key.id, r.name) for r in cdc.latest_state(changes).collect()] == [(1, "b")]
    path = str(tmp_path / "cdc")
    flat = changes.selectExpr("key.id AS id", "op", "seq_value", "after.name AS name")
    sinks.cdc_map(path, "id", "seq_value").write(flat.where("seq_value > 2"))
    sinks.cdc_map(path, "id", "seq_value").write(flat.where("seq_value <= 2"))
    assert [(r.id, r.name) for r in sinks.live(sinks.read_map(spark, path)).collect()] == [(1, "b")]


def test_file_sinks_observables_assertions(spark, tmp_path):
    s = stage(spark, [("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00")], "x string, t string").map("x", t="CAST(t AS TIMESTAMP)")
    path = str(tmp_path / "out")
    s.write_to(sinks.files(path).rolled_by_date("yyyy-MM-dd", "t").rolled_by_rows(1).build())
    assert {str(r.rolled) for r in spark.read.json(path).collect()} == {"2024-01-01", "2024-01-02"}
    seen = []
    o = sinks.Observable("r")
    o.add_observer(lambda r: seen.append(r.x))
    Pipeline(spark).write_to(o.sink(), s, s)
    assert sorted(seen) == ["a", "a", "b", "b"] and len(list(o)) == 4
    few = sinks.Observable("few", capacity=3)
    own, later = few.add_observer(seen.append), few.to_future(lambda rows: sorted(r.x for r in rows))
    assert few.remove_observer(own) and not few.remove_observer(own)
    Pipeline(spark).write_to(few.sink(), s.sort("x"), s.sort("x"))
    assert len(later.result(1)) == 3 and len(seen) == 4
    broken = few.to_future(len)
    with pytest.raises(Exception, match="no"):
        s.filter("assert_true(x = 'q', 'no') IS NULL").write_to(few.sink())
    assert broken.exception(1) is not None
    few.destroy()
    assert list(few) == []
    one = s.map("x")
    one.sort("x").write_to(sinks.assert_ordered(["a", "b"]))
    one.write_to(sinks.assert_any_order(["b", "a"]))
    one.write_to(sinks.assert_contains(["b"]))
    with pytest.raises(AssertionError):
        one.write_to(sinks.assert_contains(["z"]))
    out = tmp_path / "built"
    out.mkdir()
    where = str(out)

    def opened():
        import uuid

        return open(f"{where}/{uuid.uuid4().hex}", "w")

    one.write_to(sinks.from_builder(opened, lambda f, r: f.write(r.x), destroy=lambda f: f.close()))
    assert sorted("".join(p.read_text() for p in out.iterdir())) == ["a", "b"]
    one.write_to(sinks.noop())
