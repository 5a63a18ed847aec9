"""Keyed state over streams, by transformWithState; the session needs the RocksDB state store.

    spark.sql.streaming.stateStore.providerClass =
        org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _processor(names, ts, create, fn, fields, ttl_ms, on_evict):
    from pyspark.sql.streaming import StatefulProcessor

    class Processor(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "data binary, touched long")

        def _frame(self, rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=fields)

        def _evict(self, key, state, touched) -> list[dict]:
            return _rows(on_evict(state, key, touched + ttl_ms)) if on_evict else []

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            held = self.state.get() if self.state.exists() else None
            state, touched = (pickle.loads(held[0]), held[1]) if held else (create(), None)
            mark = timerValues.getCurrentWatermarkInMs()
            out: list[dict] = []
            batch = pd.concat(list(rows), ignore_index=True).sort_values(ts, kind="stable")
            for row in batch.to_dict("records"):
                now = int(pd.Timestamp(row[ts]).timestamp() * 1000)
                if ttl_ms and now < mark:
                    continue  # late rows count only without a TTL
                if ttl_ms and touched is not None and touched < now - ttl_ms:
                    out += self._evict(key, state, touched)
                    state = create()
                touched = now if touched is None else max(touched, now)
                out += _rows(fn(state, key, row))
            if touched is not None:
                self.state.update((pickle.dumps(state), touched))
                if ttl_ms:
                    for timer in list(self.handle.listTimers()):
                        self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
                    self.handle.registerTimer(touched + ttl_ms)
            yield self._frame(out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            held = self.state.get() if self.state.exists() else None
            self.state.clear()
            yield self._frame(self._evict(key, pickle.loads(held[0]), held[1]) if held else [])

        def close(self) -> None:
            pass

    return Processor()


def _rows(made) -> list[dict]:
    return [] if made is None else [made] if isinstance(made, dict) else list(made)


def map_stateful_stream(
    df: DataFrame, keys: Sequence[str], ts: str, create: Callable[[], Any], fn: Callable, schema: str, *, ttl_ms: int = 0, on_evict: Callable | None = None, mode: str = "update"
) -> DataFrame:
    """operators.stateful.map_stateful for a stream. States over the TTL are evicted as the watermark passes."""
    if not keys:
        df, keys = df.withColumn("__one", F.lit(1)), ["__one"]
    fields = df.sparkSession.createDataFrame([], schema).columns
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_processor(list(keys), ts, create, fn, fields, ttl_ms, on_evict), outputStructType=schema, outputMode=mode, timeMode="EventTime" if ttl_ms else "None"
    )
