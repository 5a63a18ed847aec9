"""Sources: what a pipeline reads, as DataFrameReader or DataStreamReader plans.

Filters and projections are pushed down by Catalyst, so a source takes no predicate of its own unless the
original has one (tables), where it is plain ``where`` and ``select``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    read: Callable[[SparkSession], DataFrame]
    #: The column in which a stream brings its own time.
    native_ts: str | None = None


# -- tables in place of in-memory maps, caches, lists


def table(name: str, predicate: str | None = None, projection: Sequence[str] | None = None) -> Source:
    """A view or table; predicate and projection reach the scan."""

    def read(spark: SparkSession) -> DataFrame:
        df = spark.table(name)
        df = df.where(predicate) if predicate else df
        return df.selectExpr(*projection) if projection else df

    return Source(read)


map_, cache, replicated_map = table, table, table


def entries(name: str, key: str, value: Sequence[str]) -> Source:
    """A table as key-value entries; value is a struct of the named columns."""
    return Source(lambda spark: spark.table(name).select(F.col(key).alias("key"), F.struct(*value).alias("value")))


def list_(items: Sequence[Any], schema: str) -> Source:
    """Items with their place in the list as ``index``."""

    def read(spark: SparkSession) -> DataFrame:
        rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(items)]
        return spark.createDataFrame(rows, f"index long, {schema}")

    return Source(read)


def journal(path: str, schema: str, *, predicate: str | None = None, projection: Sequence[str] | None = None, from_start: bool = True, max_files: int = 1000) -> Source:
    """A change feed: files appended to a folder (JSON lines; an ``op`` column says ADDED, UPDATED, REMOVED).

    from_start=False begins with files that are written from the making of the stream on.
    """

    def read(spark: SparkSession) -> DataFrame:
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
        if not from_start:
            now = datetime.now(UTC)
            df = df.where(F.col("_metadata.file_modification_time") >= F.lit(now)).select(*df.columns)
        df = df.where(predicate) if predicate else df
        return df.selectExpr(*projection) if projection else df

    return Source(read)


# -- files

#: Format names to reader formats, with the options that give the stated behaviour.
FORMATS = {
    "csv": ("csv", {"header": "true", "inferSchema": "false", "mode": "PERMISSIVE"}),
    "json": ("json", {}),
    "json_multiline": ("json", {"multiLine": "true"}),
    "parquet": ("parquet", {}),
    "avro": ("avro", {}),
    "orc": ("orc", {}),
    "lines": ("text", {}),
    "text": ("text", {"wholetext": "true"}),
    "bytes": ("binaryFile", {}),
}


@dataclass(frozen=True)
class FileSourceBuilder:
    """files(path).with_format("csv").with_glob("*.csv").build()"""

    path: str
    fmt: str = "lines"
    glob: str | None = None
    schema: str | None = None
    options: tuple[tuple[str, str], ...] = ()
    ignore_missing: bool = False
    with_name: bool = False

    def _set(self, **changes) -> FileSourceBuilder:
        return FileSourceBuilder(**({f: getattr(self, f) for f in self.__dataclass_fields__} | changes))

    def with_format(self, fmt: str, schema: str | None = None) -> FileSourceBuilder:
        if fmt not in FORMATS:
            raise ValueError(f"no format {fmt}: one of {', '.join(FORMATS)}")
        return self._set(fmt=fmt, schema=schema or self.schema)

    def with_glob(self, glob: str) -> FileSourceBuilder:
        return self._set(glob=glob)

    def with_option(self, key: str, value: str) -> FileSourceBuilder:
        return self._set(options=(*self.options, (key, value)))

    def with_charset(self, charset: str) -> FileSourceBuilder:
        return self.with_option("encoding", charset)

    def ignore_file_not_found(self, ignore: bool = True) -> FileSourceBuilder:
        return self._set(ignore_missing=ignore)

    def with_file_name(self) -> FileSourceBuilder:
        """Adds ``file_name``."""
        return self._set(with_name=True)

    def _configured(self, reader):
        name, defaults = FORMATS[self.fmt]
        reader = reader.format(name).options(**defaults).options(**dict(self.options))
        reader = reader.option("pathGlobFilter", self.glob) if self.glob else reader
        return reader.schema(self.schema) if self.schema else reader

    def _missing(self, spark: SparkSession) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return found is None or len(found) == 0

    def read(self, spark: SparkSession) -> DataFrame:
        if self.ignore_missing and self._missing(spark):
            return spark.createDataFrame([], self.schema or "value string")
        df = self._configured(spark.read).load(self.path)
        return df.withColumn("file_name", F.col("_metadata.file_name")) if self.with_name else df

    def build(self) -> Source:
        return Source(self.read)

    def build_watcher(self, max_files: int = 1000) -> Source:
        """New files of the folder as a stream, in any format. file_watcher sees appended lines too."""

        def read(spark: SparkSession) -> DataFrame:
            fixed = self if self.schema or FORMATS[self.fmt][0] in ("text", "binaryFile") else None
            if fixed is None:
                raise ValueError(f"a stream of {self.fmt} files needs a schema")
            df = self._configured(spark.readStream.option("maxFilesPerTrigger", max_files)).load(self.path)
            return df.withColumn("file_name", F.col("_metadata.file_name")) if self.with_name else df

        return Source(read)


def files(path: str) -> FileSourceBuilder:
    return FileSourceBuilder(path)


def parquet(path: str) -> Source:
    return files(path).with_format("parquet").build()


def json(path: str, schema: str | None = None) -> Source:
    """One document a line. Without a schema numbers are doubles, nested values JSON text."""
    if schema:
        return files(path).with_format("json", schema).build()

    def read(spark: SparkSession) -> DataFrame:
        from pyspark.sql import types as T

        df = files(path).with_format("json").read(spark)
        cols = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.NumericType):
                c = c.cast("double")
            elif isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
                c = F.to_json(c)
            cols.append(c.alias(f.name))
        return df.select(*cols)

    return Source(read)


def file_watcher(path: str, glob: str | None = None, *, charset: str = "utf-8", only_new: bool = False) -> Source:
    """Lines added to the folder's files, to old and new ones, as ``value`` with ``file_name``; only_new leaves out what is there at the start."""

    def read(spark: SparkSession) -> DataFrame:
        from tidewater.sources.tail import TailSource

        spark.dataSource.register(TailSource)
        options = {"path": path, "glob": glob or "*", "charset": charset, "from": "end" if only_new else "start"}
        return spark.readStream.format(TailSource.name()).options(**options).load()

    return Source(read)


def json_watcher(path: str, schema: str, glob: str | None = None) -> Source:
    """file_watcher, each line a JSON document."""
    lines = file_watcher(path, glob)
    return Source(lambda spark: lines.read(spark).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("__row")).select("__row.*"))


def hadoop(path: str, fmt: str = "parquet", **options: str) -> Source:
    """Any file system that the cluster's Hadoop configuration knows, by its scheme."""
    made = files(path).with_format(fmt)
    for key, value in options.items():
        made = made.with_option(key, value)
    return made.build()


def s3(bucket: str, prefixes: Sequence[str] = ("",), fmt: str = "lines", schema: str | None = None) -> Source:
    """Objects under prefixes, through the s3a file system."""

    def read(spark: SparkSession) -> DataFrame:
        name, defaults = FORMATS[fmt]
        reader = spark.read.format(name).options(**defaults)
        reader = reader.schema(schema) if schema else reader
        return reader.load([f"s3a://{bucket}/{p}" for p in prefixes])

    return Source(read)


# -- sockets, databases, brokers


def socket(host: str, port: int) -> Source:
    return Source(lambda spark: spark.readStream.format("socket").option("host", host).option("port", port).load())


def jdbc(url: str, query: str, *, partition_column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 1, **options: str) -> Source:
    """One query, or with a partition column several ranges of it in parallel."""

    def read(spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        if partition_column is None:
            return reader.option("query", query).load()
        return (
            reader.option("dbtable", f"({query}) AS q").option("partitionColumn", partition_column)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()
        )

    return Source(read)


def kafka(servers: str, topics: Sequence[str], *, starting: str = "earliest", batch: bool = False, max_offsets: int | None = None, **options: str) -> Source:
    """Needs Spark's Kafka package on the class path. Offsets are kept in the query's checkpoint."""

    def read(spark: SparkSession) -> DataFrame:
        reader = (spark.read if batch else spark.readStream).format("kafka").option("kafka.bootstrap.servers", servers)
        reader = reader.option("subscribe", ",".join(topics)).option("startingOffsets", starting).options(**options)
        return (reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader).load()

    return Source(read, "timestamp")


def external(fmt: str, *, stream: bool = False, native_ts: str | None = None, schema: str | None = None, **options: str) -> Source:
    """Any data source of the session by its name: search engines, message queues, cloud streams through their connector packages,
    or a Python data source registered with the session."""

    def read(spark: SparkSession) -> DataFrame:
        reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
        return (reader.schema(schema) if schema else reader).load()

    return Source(read, native_ts)


# -- custom sources


def from_builder(name: str, schema: str, create: Callable[[dict], Any], fill: Callable[[Any], Iterator[tuple]], *, partitions: int = 1) -> Source:
    """A batch source from functions: create(options) makes a context in each partition, fill(context) gives its rows.

    The options say which partition it is: ``{"partition": i, "partitions": n}``.
    """

    def read(spark: SparkSession) -> DataFrame:
        from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

        class Reader(DataSourceReader):
            def partitions(self):
                return [InputPartition(i) for i in range(partitions)]

            def read(self, partition):
                yield from fill(create({"partition": partition.value, "partitions": partitions}))

        class Made(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return schema

            def reader(self, schema):
                return Reader()

        spark.dataSource.register(Made)
        return spark.read.format(name).load()

    return Source(read)


def stream_from_builder(name: str, schema: str, create: Callable[[], Any], fill: Callable[[Any, dict], tuple[list[tuple], dict]], *, native_ts: str | None = None) -> Source:
    """A stream from functions: fill(context, offset) gives new rows and the next offset, both kept by Spark's checkpoint."""

    def read(spark: SparkSession) -> DataFrame:
        from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

        class Reader(SimpleDataSourceStreamReader):
            def initialOffset(self):
                return {"at": 0}

            def read(self, start):
                rows, after = fill(create(), start)
                return iter(rows), after

            def readBetweenOffsets(self, start, end):
                rows, at, context = [], start, create()
                while at != end:
                    more, at = fill(context, at)
                    rows += more
                return iter(rows)

            def commit(self, end):
                pass

        class Made(DataSource):
            @classmethod
            def name(cls):
                return name

            def schema(self):
                return schema

            def simpleStreamReader(self, schema):
                return Reader()

        spark.dataSource.register(Made)
        return spark.readStream.format(name).load()

    return Source(read, native_ts)


# -- test sources


def items(rows: Sequence[Any], schema: str) -> Source:
    return Source(lambda spark: spark.createDataFrame([r if isinstance(r, tuple | list | dict) else (r,) for r in rows], schema))


def items_distributed(*parts: Sequence[Any], schema: str) -> Source:
    """Each list in a partition of its own."""

    def read(spark: SparkSession) -> DataFrame:
        made = [items(p, schema).read(spark).repartition(1) for p in parts]
        out = made[0]
        for df in made[1:]:
            out = out.union(df)
        return out

    return Source(read)


def item_stream(per_second: int) -> Source:
    """timestamp and sequence, so many a second."""
    return Source(lambda spark: spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select("timestamp", F.col("value").alias("sequence")), "timestamp")


def long_stream(per_second: int) -> Source:
    return Source(lambda spark: spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select("timestamp", "value"), "timestamp")


def rate_micro_batch(rows_per_batch: int, start_ms: int = 0, step_ms: int = 1000) -> Source:
    """So many rows in each micro-batch, at times that the batch number fixes: for repeatable tests."""
    return Source(
        lambda spark: spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("startTimestamp", start_ms)
        .option("advanceMillisPerBatch", step_ms).load(),
        "timestamp",
    )
