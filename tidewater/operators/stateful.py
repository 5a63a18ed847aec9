"""Running aggregates and keyed state over batch DataFrames; streaming.state has the same for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.aggregates import Aggregate


def rolling(df: DataFrame, keys: Sequence[Column], order: Sequence[Column], ops: dict[str, Aggregate]) -> DataFrame:
    """Each row with the results over its key's rows up to it, in the given order."""
    frame = W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)

    def over(op: Aggregate) -> Column:
        if op.prepare:
            raise ValueError("flat-mapping operations have no rolling form")
        made = op.build(None).over(frame)
        return made if op.empty is None else F.coalesce(made, op.empty if isinstance(op.empty, Column) else F.lit(op.empty))

    return df.select("*", *[over(op).alias(n) for n, op in ops.items()])


def map_stateful(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    create: Callable[[], Any],
    fn: Callable[[Any, tuple, dict], dict | list[dict] | None],
    schema: str,
    *,
    ttl_ms: int = 0,
    on_evict: Callable[[Any, tuple, int], dict | list[dict] | None] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """A key's rows, in order of time, go through fn(state, key, row) with one mutable state; what it returns is given out.

    With a TTL, a state that was last touched more than that before a row is evicted first: on_evict(state, key, time) may give
    rows, and a new state begins. The end of input evicts what is left. A key's rows are streamed through one task in sorted order; memory holds one state.
    """
    sorts = [ts, *order]

    def rows_of(made) -> list[dict]:
        return [] if made is None else [made] if isinstance(made, dict) else list(made)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last = None, None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_dict("records"):
                own = tuple(row[k] for k in keys)
                now = int(row.pop("__ms"))
                if key is not None and own != key:
                    if ttl_ms and on_evict:
                        out += rows_of(on_evict(state, key, last + ttl_ms))
                    key = None
                if key is None:
                    key, state, last = own, create(), now
                elif ttl_ms and last < now - ttl_ms:
                    if on_evict:
                        out += rows_of(on_evict(state, key, last + ttl_ms))
                    state = create()
                last = max(last, now)
                out += rows_of(fn(state, key, row))
            yield pd.DataFrame(out, columns=fields)
        if key is not None and ttl_ms and on_evict:
            yield pd.DataFrame(rows_of(on_evict(state, key, last + ttl_ms)), columns=fields)

    fields = _fields(df, schema)
    marked = df.withColumn("__ms", F.unix_millis(F.col(ts).cast("timestamp")) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts))
    dealt = marked.repartition(*keys) if keys else marked.coalesce(1)
    return dealt.sortWithinPartitions(*keys, *sorts).mapInPandas(run, schema)


def _fields(df: DataFrame, schema: str) -> list[str]:
    return df.sparkSession.createDataFrame([], schema).columns
