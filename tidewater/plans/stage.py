"""The builder: stages that wrap a DataFrame, with its event-time column, keys and window.

Nothing runs until write_to, collect or start: a stage is a logical plan, which Catalyst optimizes as a whole. Streams use the
same methods; what a streaming plan can't do raises as Spark says it.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.aggregates import Aggregate, CoAggregate, ColumnLike, Custom, col
from tidewater.operators import enrich, grouping, joins, stateful
from tidewater.operators.windows import WindowDefinition


@dataclass
class Pipeline:
    """Where sources are read and sinks are written."""

    spark: SparkSession
    #: Rows have no order of their own in Spark: with this, reads of files carry ``source_order`` for a later sort.
    preserve_order: bool = False

    def read_from(self, source) -> Stage:
        df = source.read(self.spark)
        if self.preserve_order and not df.isStreaming:
            df = df.withColumn("source_order", F.monotonically_increasing_id())
        return SourceStage(df, native_ts=source.native_ts) if df.isStreaming else Stage(df)

    def write_to(self, sink, *stages: Stage) -> Any:
        """Several stages into one sink."""
        first, *rest = stages
        return first.merge(*rest).write_to(sink)


def _cols(columns: Sequence[ColumnLike]) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c) if c.isidentifier() else F.expr(c) for c in columns]


@dataclass(frozen=True)
class Stage:
    df: DataFrame
    ts: str | None = None
    name: str = ""
    #: Milliseconds between early results of the windows that this stage aggregates; 0 for none.
    early_ms: int = 0

    def _with(self, df: DataFrame) -> Stage:
        keep = self.ts if self.ts in df.columns else None
        return Stage(df, keep, self.name, self.early_ms)

    # -- one row at a time

    def map(self, *exprs: ColumnLike, **named: ColumnLike) -> Stage:
        """The given expressions. A single one that is null drops its row."""
        cols = [*_cols(exprs), *[col(e).alias(n) for n, e in named.items()]]
        out = self.df.select(*cols)
        return self._with(out.where(F.col(f"`{out.columns[0]}`").isNotNull()) if len(cols) == 1 else out)

    def map_rows(self, fn: Callable[[dict], dict | None], schema: str) -> Stage:
        """A Python function of a row, in Arrow batches; null drops the row. Slower than expressions."""
        return self.flat_map_rows(lambda row: [] if (made := fn(row)) is None else [made], schema)

    def filter(self, condition: ColumnLike) -> Stage:
        return self._with(self.df.where(col(condition)))

    def flat_map(self, array: ColumnLike, name: str = "item", *keep: ColumnLike) -> Stage:
        """A row for each element of an array; null and empty arrays give none."""
        return self._with(self.df.select(*_cols(keep), F.explode(col(array)).alias(name)))

    def flat_map_rows(self, fn: Callable[[dict], list[dict]], schema: str) -> Stage:
        fields = self.df.sparkSession.createDataFrame([], schema).columns

        def run(batches):
            for batch in batches:
                yield pd.DataFrame([out for row in batch.to_dict("records") for out in fn(row)], columns=fields)

        return self._with(self.df.mapInPandas(run, schema))

    # -- whole stages

    def merge(self, *others: Stage) -> Stage:
        """All rows of all stages, repeated ones too."""
        df = self.df
        for other in others:
            df = df.unionByName(other.df)
        return self._with(df)

    def distinct(self) -> Stage:
        return self._with(self.df.dropDuplicates())

    def sort(self, *by: ColumnLike) -> Stage:
        return self._with(self.df.orderBy(*(_cols(by) or [F.col(f"`{c}`") for c in self.df.columns])))

    def rebalance(self, *keys: ColumnLike, parallelism: int | None = None) -> Stage:
        """Rows dealt evenly, or by key."""
        if keys:
            return self._with(self.df.repartition(*([parallelism] if parallelism else []), *_cols(keys)))
        n = parallelism or self.df.sparkSession.sparkContext.defaultParallelism
        return self._with(self.df.repartition(n))

    def add_timestamps(self, ts: ColumnLike, allowed_lag_ms: int = 0, name: str = "event_time") -> Stage:
        """An event-time column; on a stream also its watermark."""
        df = self.df.withColumn(name, col(ts).cast("timestamp"))
        return Stage(df.withWatermark(name, f"{allowed_lag_ms} milliseconds") if df.isStreaming else df, name, self.name)

    def peek(self, name: str = "peek", condition: ColumnLike | None = None, to_string: Callable[[dict], str] | None = None) -> Stage:
        """Counts what passes (rows; rows that meet the condition) under a name that query listeners see. With to_string the executors also log
        the rows (those that meet the condition) to the logger of that name."""
        seen = [F.count(F.lit(1)).alias("rows")] + ([F.count_if(col(condition)).alias("matching")] if condition is not None else [])
        df = self.df.observe(name, *seen)
        if to_string is not None:
            marked = df.withColumn("__peek", F.coalesce(col(condition), F.lit(False)) if condition is not None else F.lit(True))

            def run(batches):
                log = logging.getLogger(name)
                for batch in batches:
                    rows = batch.drop(columns="__peek")
                    for row in rows[batch["__peek"]].to_dict("records"):
                        log.warning("%s", to_string(row))
                    yield rows

            df = marked.mapInPandas(run, df.schema)
        return self._with(df)

    def apply(self, fn: Callable[[Stage], Stage]) -> Stage:
        return fn(self)

    def custom_transform(self, fn: Callable, schema: str | None = None) -> Stage:
        """fn over Arrow batches as pandas frames with a schema; without one, over the DataFrame itself."""
        return self._with(self.df.mapInPandas(fn, schema) if schema else fn(self.df))

    def set_name(self, name: str) -> Stage:
        return replace(self, name=name)

    def set_local_parallelism(self, n: int) -> Stage:
        return self._with(self.df.coalesce(n))

    # -- joins and services

    def hash_join(self, other: Stage, clause: joins.JoinClause, *output: ColumnLike, tag: str = "right") -> Stage:
        return self.hash_join_builder().add(tag, other, clause).build(*output)

    def inner_hash_join(self, other: Stage, clause: joins.JoinClause, *output: ColumnLike, tag: str = "right") -> Stage:
        return self.hash_join_builder().add_inner(tag, other, clause).build(*output)

    def hash_join2(self, other1: Stage, clause1, other2: Stage, clause2, *output: ColumnLike) -> Stage:
        return self.hash_join_builder().add("right1", other1, clause1).add("right2", other2, clause2).build(*output)

    def inner_hash_join2(self, other1: Stage, clause1, other2: Stage, clause2, *output: ColumnLike) -> Stage:
        return self.hash_join_builder().add_inner("right1", other1, clause1).add_inner("right2", other2, clause2).build(*output)

    def hash_join_builder(self) -> HashJoinBuilder:
        return HashJoinBuilder(self, joins.HashJoin(self.df))

    def map_using_service(self, factory, fn, schema: str) -> Stage:
        return self._with(enrich.map_using_service(self.df, factory, fn, schema))

    def filter_using_service(self, factory, fn) -> Stage:
        return self._with(enrich.filter_using_service(self.df, factory, fn))

    def flat_map_using_service(self, factory, fn, schema: str) -> Stage:
        return self._with(enrich.flat_map_using_service(self.df, factory, fn, schema))

    def map_using_service_async(self, factory, fn, schema: str, **options) -> Stage:
        return self._with(enrich.map_using_service_async(self.df, factory, fn, schema, **options))

    def map_using_service_batched(self, factory, fn, schema: str, **options) -> Stage:
        return self._with(enrich.map_using_service_batched(self.df, factory, fn, schema, **options))

    def map_using_python(self, column: str, fn, output: str = "result") -> Stage:
        return self._with(enrich.map_using_python(self.df, column, fn, output))

    def map_using_map(self, table: DataFrame | Stage, key: ColumnLike, output: str = "value", **names) -> Stage:
        return self._with(enrich.map_using_lookup(self.df, key, getattr(table, "df", table), output=output, **names))

    map_using_replicated_map = map_using_map

    # -- aggregation

    def grouping_key(self, *keys: ColumnLike, strict: bool = False, **named: ColumnLike) -> KeyedStage:
        """strict: a null key raises; else null is a key like any other."""
        cols = [*_cols(keys), *[col(e).alias(n) for n, e in named.items()]]
        stage = self
        if strict:
            for c in cols:
                stage = stage._with(stage.df.where(F.assert_true(c.isNotNull(), F.lit("null key")).isNull()))
        return KeyedStage(stage, tuple(cols))

    def window(self, definition: WindowDefinition) -> WindowedStage:
        return WindowedStage(self, (), definition)

    def aggregate(self, op=None, **ops) -> Stage:
        return KeyedStage(self, ()).aggregate(op, **ops)

    def aggregate2(self, op0, other: Stage, op1) -> Stage:
        return KeyedStage(self, ()).aggregate2(op0, KeyedStage(other, ()), op1)

    def aggregate3(self, op0, other1: Stage, op1, other2: Stage, op2) -> Stage:
        return KeyedStage(self, ()).aggregate3(op0, KeyedStage(other1, ()), op1, KeyedStage(other2, ()), op2)

    def aggregate_builder(self, op0=None) -> GroupAggregateBuilder:
        return KeyedStage(self, ()).aggregate_builder(op0)

    def rolling_aggregate(self, *order: ColumnLike, **ops: Aggregate) -> Stage:
        return KeyedStage(self, ()).rolling_aggregate(*order, **ops)

    def map_stateful(self, create, fn, schema: str, **options) -> Stage:
        return KeyedStage(self, ()).map_stateful(create, fn, schema, **options)

    # -- ends

    def write_to(self, sink) -> Any:
        if self.early_ms and self.df.isStreaming:
            raise ValueError("early and final results take two queries: streaming.early.start_with_early_results")
        if self.name:
            self.df.sparkSession.sparkContext.setJobDescription(self.name)
        return sink.write(self.df)

    def collect(self) -> list:
        return self.df.collect()


@dataclass(frozen=True)
class SourceStage(Stage):
    """A stream whose timestamps aren't chosen yet: pick one of the four ways first."""

    native_ts: str | None = None

    def without_timestamps(self) -> Stage:
        return Stage(self.df, None, self.name)

    def with_ingestion_timestamps(self, name: str = "event_time") -> Stage:
        return Stage(self.df.withColumn(name, F.current_timestamp()).withWatermark(name, "0 seconds"), name, self.name)

    def with_native_timestamps(self, allowed_lag_ms: int = 0) -> Stage:
        if not self.native_ts:
            raise ValueError("the source has no timestamps of its own")
        return self.add_timestamps(F.col(self.native_ts), allowed_lag_ms)

    def with_timestamps(self, ts: ColumnLike, allowed_lag_ms: int = 0) -> Stage:
        return self.add_timestamps(ts, allowed_lag_ms)


@dataclass
class HashJoinBuilder:
    stage: Stage
    join: joins.HashJoin

    def add(self, tag: str, other: Stage, clause: joins.JoinClause) -> HashJoinBuilder:
        self.join.add(tag, other.df, clause)
        return self

    def add_inner(self, tag: str, other: Stage, clause: joins.JoinClause) -> HashJoinBuilder:
        self.join.add_inner(tag, other.df, clause)
        return self

    def build(self, *output: ColumnLike) -> Stage:
        return self.stage._with(self.join.build(*output))


def _ops(op, ops: dict) -> dict:
    return ({"result": op} if op is not None else {}) | ops


@dataclass(frozen=True)
class KeyedStage:
    stage: Stage
    keys: tuple[Column, ...]

    @property
    def _input(self) -> tuple[DataFrame, Sequence[Column]]:
        return self.stage.df, self.keys

    def window(self, definition: WindowDefinition) -> WindowedStage:
        return WindowedStage(self.stage, self.keys, definition)

    def distinct(self, *order: ColumnLike) -> Stage:
        """One row of each key: the first by the order, any without one."""
        df, keys = self._input
        names = [f"__k{i}" for i in range(len(keys))]
        keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
        if not order:
            return self.stage._with(keyed.dropDuplicates(names).drop(*names))
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        first = keyed.groupBy(*names).agg(F.min_by(row, F.struct(*_cols(order))).alias("__row"))  # no window: partial aggregation
        return self.stage._with(first.select("__row.*"))

    def aggregate(self, op=None, **ops) -> Stage:
        return Stage(grouping.aggregate(self.stage.df, self.keys, _ops(op, ops)))

    def aggregate2(self, op0, other: KeyedStage, op1) -> Stage:
        """Columns f0 and f1; with op0 alone a co-aggregate (op1 None)."""
        return self._many([self, other], [op0, op1])

    def aggregate3(self, op0, other1: KeyedStage, op1, other2: KeyedStage, op2) -> Stage:
        return self._many([self, other1, other2], [op0, op1, op2])

    def co_aggregate(self, op: CoAggregate | Custom, *others: KeyedStage) -> Stage:
        """One operation that takes several inputs."""
        return Stage(grouping.co_group([s._input for s in (self, *others)], op))

    @staticmethod
    def _many(stages: Sequence[KeyedStage], ops: Sequence) -> Stage:
        return Stage(grouping.co_aggregate([s._input for s in stages], [(f"f{i}", op) for i, op in enumerate(ops)]))

    def aggregate_builder(self, op0=None) -> GroupAggregateBuilder:
        return GroupAggregateBuilder([("f0", self, op0)])

    def rolling_aggregate(self, *order: ColumnLike, **ops: Aggregate) -> Stage:
        by = _cols(order or ([self.stage.ts] if self.stage.ts else []))
        if not by:
            raise ValueError("rows have no order: name the columns to go by")
        return self.stage._with(stateful.rolling(self.stage.df, self.keys, by, ops))

    def map_stateful(self, create, fn, schema: str, *, ttl_ms: int = 0, on_evict=None, order: Sequence[str] = ()) -> Stage:
        """fn(state, key, row) with mutable state per key, by event time; see operators.stateful and streaming.state."""
        if not self.stage.ts:
            raise ValueError("add timestamps first")
        df, names = self.stage.df, [f"__k{i}" for i in range(len(self.keys))]
        keyed = df.select("*", *[k.alias(n) for k, n in zip(self.keys, names, strict=True)])
        if df.isStreaming:
            from tidewater.streaming.state import map_stateful_stream

            return Stage(map_stateful_stream(keyed, names, self.stage.ts, create, fn, schema, ttl_ms=ttl_ms, on_evict=on_evict))
        return Stage(stateful.map_stateful(keyed, names, self.stage.ts, create, fn, schema, ttl_ms=ttl_ms, on_evict=on_evict, order=order))

    def filter_stateful(self, create, fn, **options) -> Stage:
        """Rows for which fn(state, key, row) holds."""
        schema = self.stage.df.schema
        own = schema.names
        keep = lambda state, key, row: {n: row[n] for n in own} if fn(state, key, row) else None
        return self.map_stateful(create, keep, schema.toDDL() if hasattr(schema, "toDDL") else self.stage.df._jdf.schema().toDDL(), **options)

    flat_map_stateful = map_stateful

    def map_using_service(self, factory, fn, schema: str) -> Stage:
        return self.stage._with(enrich.map_using_service(self.stage.df, factory, fn, schema, self.keys))

    def filter_using_service(self, factory, fn) -> Stage:
        return self.stage._with(enrich.filter_using_service(self.stage.df, factory, fn, self.keys))

    def flat_map_using_service(self, factory, fn, schema: str) -> Stage:
        return self.stage._with(enrich.flat_map_using_service(self.stage.df, factory, fn, schema, self.keys))

    def map_using_service_async(self, factory, fn, schema: str, **options) -> Stage:
        return self.stage._with(enrich.map_using_service_async(self.stage.df, factory, fn, schema, keys=self.keys, **options))

    def map_using_service_batched(self, factory, fn, schema: str, **options) -> Stage:
        return self.stage._with(enrich.map_using_service_batched(self.stage.df, factory, fn, schema, keys=self.keys, **options))

    def map_using_python(self, column: str, fn, output: str = "result") -> Stage:
        return self.stage._with(enrich.map_using_python(self.stage.df, column, fn, output, keys=self.keys))

    def map_using_map(self, table, output: str = "value", **names) -> Stage:
        if len(self.keys) != 1:
            raise ValueError("a lookup takes one key")
        return self.stage.map_using_map(table, self.keys[0], output, **names)

    def custom_transform(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Stage:
        """fn over all rows of a key as one pandas frame: groups must fit in memory."""
        return Stage(self.stage.df.groupBy(*self.keys).applyInPandas(fn, schema))


@dataclass
class GroupAggregateBuilder:
    """Co-aggregation of any number of inputs; each tag becomes a column."""

    inputs: list[tuple[str, Any, Any]]

    def add(self, tag: str, stage, op=None) -> GroupAggregateBuilder:
        self.inputs.append((tag, stage if hasattr(stage, "keys") else KeyedStage(stage, ()), op))
        return self

    def build(self, op: CoAggregate | Custom | None = None) -> Stage:
        stages = [s for _, s, _ in self.inputs]
        if op is not None:
            return stages[0].co_aggregate(op, *stages[1:]) if not isinstance(stages[0], WindowedStage) else stages[0]._co(stages, op)
        pairs = [(s._input, (tag, o)) for tag, s, o in self.inputs]
        out = grouping.co_aggregate([p[0] for p in pairs], [p[1] for p in pairs])
        return stages[0]._finish(out) if isinstance(stages[0], WindowedStage) else Stage(out)


@dataclass(frozen=True)
class WindowedStage:
    """Rows by window, and by keys if there are any. Results have window_start and window_end."""

    stage: Stage
    keys: tuple[Column, ...]
    definition: WindowDefinition

    def __post_init__(self):
        if not self.stage.ts:
            raise ValueError("windows need timestamps: add them first")

    def grouping_key(self, *keys: ColumnLike, **named: ColumnLike) -> WindowedStage:
        return replace(self, keys=self.stage.grouping_key(*keys, **named).keys)

    @property
    def _input(self) -> tuple[DataFrame, Sequence[Column]]:
        return self.stage.df, (self.definition.column(F.col(self.stage.ts)).alias("__window"), *self.keys)

    def _finish(self, out: DataFrame) -> Stage:
        rest = [c for c in out.columns if c != "__window"]
        done = out.select(*self.definition.bounds(), *[f"`{c}`" for c in rest])
        # a result belongs to the last moment of its window, so that windows can follow each other
        done = done.withColumn("result_time", F.timestamp_micros(F.unix_micros("window_end") - 1)) if not done.isStreaming else done.withColumn("result_time", F.col("window_end"))
        return Stage(done, "result_time", early_ms=self.definition.early)

    def aggregate(self, op=None, **ops) -> Stage:
        df, keys = self._input
        ops = _ops(op, ops)
        if df.isStreaming:
            if odd := [n for n, o in ops.items() if not isinstance(o, Aggregate) or o.prepare]:
                raise ValueError(f"not on streams: {', '.join(odd)} (nested, flat-mapping and custom operations group twice or in Python)")
            plain = [o.column().alias(n) for n, o in ops.items()]
            return self._finish(df.groupBy(*keys).agg(*plain))
        return self._finish(grouping.aggregate(df, keys, ops))

    def distinct(self) -> Stage:
        """The distinct rows of each window; with keys one row (any) of each key."""
        df, keys = self._input
        if self.keys:
            row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
            return self._finish(df.groupBy(*keys).agg(F.any_value(row).alias("item")))
        rest = [F.col(f"`{c}`") for c in df.columns if c != self.stage.ts]
        return self._finish(df.groupBy(*keys, *rest).agg(F.count(F.lit(1)).alias("times")).drop("times"))

    def aggregate2(self, op0, other: WindowedStage, op1) -> Stage:
        return self._co_many([self, other], [op0, op1])

    def aggregate3(self, op0, other1: WindowedStage, op1, other2: WindowedStage, op2) -> Stage:
        return self._co_many([self, other1, other2], [op0, op1, op2])

    def co_aggregate(self, op: CoAggregate | Custom, *others: WindowedStage) -> Stage:
        return self._co([self, *others], op)

    def _co(self, stages: Sequence[WindowedStage], op) -> Stage:
        return self._finish(grouping.co_group([s._input for s in stages], op))

    def _co_many(self, stages: Sequence[WindowedStage], ops: Sequence) -> Stage:
        return self._finish(grouping.co_aggregate([s._input for s in stages], [(f"f{i}", op) for i, op in enumerate(ops)]))

    def aggregate_builder(self, op0=None) -> GroupAggregateBuilder:
        return GroupAggregateBuilder([("f0", self, op0)])
