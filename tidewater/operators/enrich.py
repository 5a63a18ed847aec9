"""Enrichment through services and lookup tables.

A service is made once in each worker process (shared) or once in each task, and called over Arrow batches. Asynchronous
calls run on a bounded pool of threads, in order or as they end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from tidewater.functions.aggregates import ColumnLike, col
from tidewater.operators.joins import small

_shared: dict[str, Any] = {}


@dataclass(frozen=True)
class ServiceFactory:
    """create(context) makes the service; destroy(service) ends it. shared: one for all tasks of a worker process.

    files are local paths that every executor gets; create finds them by name with pyspark.SparkFiles.
    """

    create: Callable[[dict], Any]
    destroy: Callable[[Any], None] | None = None
    shared: bool = False
    name: str = ""
    files: tuple[str, ...] = ()

    def __post_init__(self):
        if self.shared and not self.name:
            raise ValueError("a shared service needs a name")


def shared_service(name: str, create: Callable[[dict], Any]) -> ServiceFactory:
    return ServiceFactory(create, None, True, name)


def non_shared_service(create: Callable[[dict], Any], destroy: Callable[[Any], None] | None = None) -> ServiceFactory:
    return ServiceFactory(create, destroy)


def _with_service(factory: ServiceFactory, work: Callable[[Any, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if factory.shared:
            service = _shared.get(factory.name)
            if service is None:
                service = _shared[factory.name] = factory.create({})
            yield from work(service, batches)
            return
        service = factory.create({})
        try:
            yield from work(service, batches)
        finally:
            if factory.destroy:
                factory.destroy(service)

    return run


def _prepare(df: DataFrame, factory: ServiceFactory, keys: tuple[ColumnLike, ...]) -> DataFrame:
    for path in factory.files:
        df.sparkSession.sparkContext.addFile(path)
    return df.repartition(*[col(k) for k in keys]) if keys else df


def _frame(rows: list[dict], fields: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=fields)


def _fields(df: DataFrame, schema: str) -> list[str]:
    return df.sparkSession.createDataFrame([], schema).columns


def map_using_service(df: DataFrame, factory: ServiceFactory, fn: Callable[[Any, dict], dict | None], schema: str, keys: tuple = ()) -> DataFrame:
    """fn(service, row); null drops the row. keys: rows of a key go to one task."""
    fields = _fields(df, schema)

    def work(service, batches):
        for batch in batches:
            made = (fn(service, row) for row in batch.to_dict("records"))
            yield _frame([m for m in made if m is not None], fields)

    return _prepare(df, factory, keys).mapInPandas(_with_service(factory, work), schema)


def filter_using_service(df: DataFrame, factory: ServiceFactory, fn: Callable[[Any, dict], bool], keys: tuple = ()) -> DataFrame:
    def work(service, batches):
        for batch in batches:
            yield batch[[bool(fn(service, row)) for row in batch.to_dict("records")]]

    return _prepare(df, factory, keys).mapInPandas(_with_service(factory, work), df.schema)


def flat_map_using_service(df: DataFrame, factory: ServiceFactory, fn: Callable[[Any, dict], list[dict]], schema: str, keys: tuple = ()) -> DataFrame:
    fields = _fields(df, schema)

    def work(service, batches):
        for batch in batches:
            yield _frame([out for row in batch.to_dict("records") for out in fn(service, row)], fields)

    return _prepare(df, factory, keys).mapInPandas(_with_service(factory, work), schema)


def map_using_service_async(
    df: DataFrame, factory: ServiceFactory, fn: Callable[[Any, dict], dict | None], schema: str, *, max_concurrent: int = 4, preserve_order: bool = True, keys: tuple = ()
) -> DataFrame:
    """fn runs on up to max_concurrent threads; a window of so many calls is open at a time."""
    fields = _fields(df, schema)

    def work(service, batches):
        with ThreadPoolExecutor(max_concurrent) as pool:
            for batch in batches:
                rows = batch.to_dict("records")
                if preserve_order:
                    made = list(pool.map(lambda row: fn(service, row), rows))
                else:
                    made, todo, open_ = [], iter(rows), set()
                    while True:
                        while len(open_) < max_concurrent and (row := next(todo, None)) is not None:
                            open_.add(pool.submit(fn, service, row))
                        if not open_:
                            break
                        ended, open_ = wait(open_, return_when=FIRST_COMPLETED)
                        made += [f.result() for f in ended]
                yield _frame([m for m in made if m is not None], fields)

    return _prepare(df, factory, keys).mapInPandas(_with_service(factory, work), schema)


def map_using_service_batched(
    df: DataFrame, factory: ServiceFactory, fn: Callable[[Any, list[dict]], list[dict | None]], schema: str, *, max_batch: int = 1024, keys: tuple = ()
) -> DataFrame:
    """fn(service, rows) answers for up to max_batch rows at once, in their order."""
    fields = _fields(df, schema)

    def work(service, batches):
        for batch in batches:
            rows = batch.to_dict("records")
            out: list[dict] = []
            for at in range(0, len(rows), max_batch):
                part = rows[at : at + max_batch]
                made = fn(service, part)
                if len(made) != len(part):
                    raise ValueError(f"{len(made)} results for {len(part)} rows")
                out += [m for m in made if m is not None]
            yield _frame(out, fields)

    return _prepare(df, factory, keys).mapInPandas(_with_service(factory, work), schema)


def map_using_python(df: DataFrame, column: str, fn: Callable[[list[str]], list[str]], output: str = "result", *, keys: tuple = ()) -> DataFrame:
    """A list of strings to a list of strings, batch by batch, into a further column."""

    @F.pandas_udf("string")
    def call(values: pd.Series) -> pd.Series:
        return pd.Series(fn(values.tolist()))

    return (df.repartition(*[col(k) for k in keys]) if keys else df).withColumn(output, call(F.col(column)))


def map_using_lookup(df: DataFrame, key: ColumnLike, table: DataFrame, *, table_key: str = "key", value: str = "value", output: str = "value") -> DataFrame:
    """The value under the key in a map-like table, null where it has none. Keys in the table must be unique."""
    right = table.select(F.col(table_key).alias("__k"), F.col(value).alias("__v"))
    joined = df.join(small(right), reduce(Column.__and__, [col(key) == F.col("__k")]), "left")
    return joined.withColumn(output, F.col("__v")).drop("__k", "__v")
