"""Sinks: where a stage goes. write(df) runs a batch, or starts a query for a stream and returns it.

A folder stands for a map: rows with a key, the last one written for a key holds. Writing replaces the folder by a
new version, so there must be one writer at a time.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sink:
    batch: Callable[[DataFrame], Any]
    #: For streams: (writer) -> started query; None runs batch on each micro-batch.
    stream: Callable[[DataFrame], Any] | None = None

    def write(self, df: DataFrame) -> Any:
        if not df.isStreaming:
            return self.batch(df)
        if self.stream:
            return self.stream(df)
        return start(df, lambda part, _: self.batch(part))


def start(df: DataFrame, each: Callable[[DataFrame, int], Any], *, mode: str = "update", checkpoint: str | None = None, name: str | None = None, available_now: bool = True):
    """A query that hands each micro-batch to a function."""
    writer = df.writeStream.foreachBatch(each).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# -- keyed folders


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest version that is complete."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    done = sorted(s.getPath().toString() for s in fs.listStatus(where) if fs.exists(_fs(spark, s.getPath().toString() + "/_SUCCESS")[0]))
    return done[-1] if done else None


def read_map(spark: SparkSession, path: str) -> DataFrame | None:
    """What the map holds now; None if nothing was written."""
    at = _current(spark, path)
    return spark.read.parquet(at) if at else None


def _replace(df: DataFrame, path: str) -> None:
    spark = df.sparkSession
    old = _current(spark, path)
    n = int(old.rpartition("v")[2].partition("-")[0]) + 1 if old else 0
    df.write.parquet(f"{path}/v{n:012d}-{uuid.uuid4().hex[:8]}")
    if old:  # the version before stays for readers that have begun; older ones go
        where, fs = _fs(spark, path)
        for s in fs.listStatus(where):
            if s.getPath().toString() < old:
                fs.delete(s.getPath(), True)


def _latest(df: DataFrame, key: str, order: str | None) -> DataFrame:
    if order is None:
        return df.dropDuplicates([key])
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def map_(path: str, key: str = "key", order: str | None = None) -> Sink:
    """Puts rows by key. order says which of several rows of a key is the last; without it any is."""

    def put(df: DataFrame) -> None:
        new = _latest(df, key, order)
        old = read_map(df.sparkSession, path)
        _replace(new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new), path)

    return Sink(put)


def map_with_merging(path: str, merge: Callable[[Column, Column], Column], key: str = "key", value: str = "value") -> Sink:
    """merge(old, new) where both are there; a null value removes the key. Keys of one write must be unique: aggregate first."""

    def put(df: DataFrame) -> None:
        new = df.select(F.col(key).alias("__k"), F.col(value).alias("__new"))
        old = read_map(df.sparkSession, path)
        if old is None:
            _replace(df.select(key, value).where(F.col(value).isNotNull()), path)
            return
        both = old.select(key, value).join(new, F.col(key) == F.col("__k"), "full")
        merged = F.when(F.col("__k").isNull(), F.col(value)).when(F.col(key).isNull(), F.col("__new")).otherwise(merge(F.col(value), F.col("__new")))
        _replace(both.select(F.coalesce(key, "__k").alias(key), merged.alias(value)).where(F.col(value).isNotNull()), path)

    return Sink(put)


def map_with_updating(path: str, update: Callable[[Any, dict], Any], schema: str, key: str = "key", order: str | None = None) -> Sink:
    """update(old value or None, row) for each row of a key in order; None removes the key. schema: of key and value columns."""
    fields = [p.split()[0].strip("`") for p in schema.split(",")]
    value = next(f for f in fields if f != key)

    def put(df: DataFrame) -> None:
        import pandas as pd

        spark = df.sparkSession
        old = read_map(spark, path)
        now = (spark.createDataFrame([], schema) if old is None else old.select(*fields)).groupBy(key)

        def run(k, before: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            held = before[value].iloc[0] if len(before) else None
            for row in (rows.sort_values(order) if order else rows).to_dict("records"):
                held = update(held, row)
            return pd.DataFrame({key: [k[0]], value: [held]} if held is not None else {key: [], value: []}, dtype=object)[fields]

        _replace(now.cogroup(df.groupBy(key)).applyInPandas(run, schema), path)

    return Sink(put)


map_with_entry_processor = map_with_updating


def cdc_map(path: str, key: str, sequence: str, op: str = "op") -> Sink:
    """Applies change records: of each key the one with the highest sequence holds; deletes ('d') remove.

    A deleted key stays in the folder as a mark, so that older records that come late don't bring it back; read with live().
    """

    def put(df: DataFrame) -> None:
        old = read_map(df.sparkSession, path)
        _replace(_latest(df if old is None else old.unionByName(df), key, sequence), path)

    return Sink(put)


def live(df: DataFrame, op: str = "op") -> DataFrame:
    return df.where(F.col(op) != "d")


# -- append, files, tables


def list_(path: str) -> Sink:
    return Sink(lambda df: df.write.mode("append").parquet(path))


@dataclass(frozen=True)
class FileSinkBuilder:
    """files(path).rolled_by_date("yyyy-MM-dd", "ts").rolled_by_rows(1_000_000).build()"""

    path: str
    fmt: str = "json"
    date: tuple[str, str] | None = None
    max_rows: int = 0
    mode: str = "append"
    checkpoint: str | None = None

    def _set(self, **changes) -> FileSinkBuilder:
        return FileSinkBuilder(**({f: getattr(self, f) for f in self.__dataclass_fields__} | changes))

    def with_format(self, fmt: str) -> FileSinkBuilder:
        return self._set(fmt=fmt)

    def rolled_by_date(self, pattern: str, ts: str) -> FileSinkBuilder:
        """A folder for each formatted date."""
        return self._set(date=(pattern, ts))

    def rolled_by_rows(self, rows: int) -> FileSinkBuilder:
        return self._set(max_rows=rows)

    def overwrite(self) -> FileSinkBuilder:
        return self._set(mode="overwrite")

    def exactly_once(self, checkpoint: str) -> FileSinkBuilder:
        """For streams: the file sink's log in the folder and the checkpoint make each row appear once."""
        return self._set(checkpoint=checkpoint)

    def _shaped(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rolled", F.date_format(self.date[1], self.date[0])) if self.date else df

    def build(self) -> Sink:
        def batch(df: DataFrame) -> None:
            writer = self._shaped(df).write.mode(self.mode).format(self.fmt)
            writer = writer.option("maxRecordsPerFile", self.max_rows) if self.max_rows else writer
            (writer.partitionBy("rolled") if self.date else writer).save(self.path)

        def stream(df: DataFrame):
            writer = self._shaped(df).writeStream.format(self.fmt).option("path", self.path).outputMode("append")
            writer = writer.option("checkpointLocation", self.checkpoint or f"{self.path}/_checkpoint")
            writer = writer.option("maxRecordsPerFile", self.max_rows) if self.max_rows else writer
            return (writer.partitionBy("rolled") if self.date else writer).trigger(availableNow=True).start()

        return Sink(batch, stream)


def files(path: str) -> FileSinkBuilder:
    return FileSinkBuilder(path)


def json(path: str) -> Sink:
    return files(path).build()


def table(name: str, mode: str = "append") -> Sink:
    return Sink(lambda df: df.write.mode(mode).saveAsTable(name))


def jdbc(url: str, table: str, mode: str = "append", batch_size: int = 1000, **options: str) -> Sink:
    return Sink(lambda df: df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table).option("batchsize", batch_size).options(**options).save())


def kafka(servers: str, topic: str, *, key: str | None = None, value: str = "value", checkpoint: str | None = None, **options: str) -> Sink:
    """At least once: Spark's producer isn't transactional."""

    def shaped(df: DataFrame) -> DataFrame:
        cols = ([F.col(key).cast("string").alias("key")] if key else []) + [F.col(value).cast("string").alias("value")]
        return df.select(*cols)

    def batch(df: DataFrame) -> None:
        shaped(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options).save()

    def stream(df: DataFrame):
        writer = shaped(df).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**options)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

    return Sink(batch, stream)


def external(fmt: str, mode: str = "append", **options: str) -> Sink:
    """Any data source of the session by name, through its connector package."""
    return Sink(lambda df: df.write.format(fmt).mode(mode).options(**options).save())


def socket(host: str, port: int) -> Sink:
    """Each row's first column as a line."""

    def batch(df: DataFrame) -> None:
        def send(rows) -> None:
            import socket as net

            with net.create_connection((host, port)) as s:
                for row in rows:
                    s.sendall(f"{row[0]}\n".encode())

        df.foreachPartition(send)

    return Sink(batch)


def logger(rows: int = 20) -> Sink:
    return Sink(lambda df: df.show(rows, truncate=False))


def noop() -> Sink:
    return Sink(lambda df: df.write.format("noop").mode("overwrite").save(), lambda df: df.writeStream.format("noop").trigger(availableNow=True).start())


def from_builder(create: Callable[[], Any], receive: Callable[[Any, Any], None], flush: Callable[[Any], None] | None = None, destroy: Callable[[Any], None] | None = None) -> Sink:
    """A sink from functions: in each task create(), receive(context, row) for each row, flush(context), destroy(context)."""

    def batch(df: DataFrame) -> None:
        def run(rows) -> None:
            context = create()
            try:
                for row in rows:
                    receive(context, row)
                if flush:
                    flush(context)
            finally:
                if destroy:
                    destroy(context)

        df.foreachPartition(run)

    return Sink(batch)


# -- results that the client reads


class Observable:
    """A named result that the client reads: the last ``capacity`` rows of batches or streams are held on the driver, older ones go."""

    def __init__(self, name: str, capacity: int = 10_000):
        self.name = name
        self.rows: deque = deque(maxlen=capacity)
        self.observers: dict[str, Callable[[Any], None]] = {}
        self.waiting: list[tuple[Future, Callable[[list], Any]]] = []

    def add_observer(self, fn: Callable[[Any], None]) -> str:
        """An id to remove it by."""
        own = uuid.uuid4().hex
        self.observers[own] = fn
        return own

    def remove_observer(self, own: str) -> bool:
        return self.observers.pop(own, None) is not None

    def to_future(self, fn: Callable[[list], Any]) -> Future:
        """fn of the rows held, when the next batch has been written or has failed."""
        made: Future = Future()
        self.waiting.append((made, fn))
        return made

    def destroy(self) -> None:
        self.rows.clear()
        self.observers.clear()
        for made, _ in self.waiting:
            made.cancel()
        self.waiting.clear()

    def _take(self, df: DataFrame) -> None:
        for row in df.toLocalIterator():
            self.rows.append(row)
            for fn in list(self.observers.values()):
                fn(row)

    def _batch(self, df: DataFrame) -> None:
        failed = None
        try:
            self._take(df)
        except Exception as e:  # handed to those who wait, and raised
            failed = e
            raise
        finally:
            ended, self.waiting = self.waiting, []
            for made, fn in ended:
                made.set_exception(failed) if failed else made.set_result(fn(list(self.rows)))

    def sink(self) -> Sink:
        return Sink(self._batch, lambda df: start(df, lambda part, _: self._take(part)))

    def __iter__(self):
        return iter(list(self.rows))


# -- assertions


def assert_collected(check: Callable[[list], None]) -> Sink:
    return Sink(lambda df: check(df.collect()))


def _plain(rows) -> list:
    return [r if isinstance(r, tuple) and not hasattr(r, "asDict") else tuple(r) if hasattr(r, "asDict") else (r,) for r in rows]


def assert_ordered(expected: list) -> Sink:
    def check(rows: list) -> None:
        assert _plain(rows) == _plain(expected), f"{_plain(rows)} is not {_plain(expected)}"

    return assert_collected(check)


def assert_any_order(expected: list) -> Sink:
    def check(rows: list) -> None:
        assert sorted(_plain(rows), key=repr) == sorted(_plain(expected), key=repr), f"{_plain(rows)} is not {_plain(expected)}"

    return assert_collected(check)


def assert_contains(expected: list) -> Sink:
    def check(rows: list) -> None:
        missing = [e for e in _plain(expected) if e not in _plain(rows)]
        assert not missing, f"missing: {missing}"

    return assert_collected(check)
