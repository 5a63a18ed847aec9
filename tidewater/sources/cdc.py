"""Change data capture: parsing of change events, and the state that they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_changes(df: DataFrame, row_schema: str, *, key_schema: str, value: str = "value", key: str = "key") -> DataFrame:
    """key, op ('c', 'r', 'u', 'd'), ts_ms, seq_source, seq_value, before and after of change events in JSON.

    The sequence of a source orders its events; it falls back to the event's time where there is no position.
    """
    envelope = f"op string, ts_ms long, before struct<{_struct(row_schema)}>, after struct<{_struct(row_schema)}>, source struct<ts_ms: long, pos: long, lsn: long, file: string, snapshot: string>"
    parsed = df.select(F.from_json(key, key_schema).alias("key"), F.from_json(value, envelope).alias("v"))
    return parsed.where(F.col("v.op").isNotNull()).select(
        "key", "v.op", "v.ts_ms",
        F.coalesce(F.col("v.source.file"), F.lit("")).alias("seq_source"),
        F.coalesce("v.source.lsn", "v.source.pos", "v.source.ts_ms", "v.ts_ms").alias("seq_value"),
        "v.before", "v.after",
    )


def _struct(ddl: str) -> str:
    return ", ".join(": ".join(p.strip().split(None, 1)) for p in ddl.split(","))


def latest_state(changes: DataFrame) -> DataFrame:
    """The rows that are there after all changes: the last of each key by sequence, without the deleted."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("op", "after"), F.struct("seq_source", "seq_value", "ts_ms")).alias("last"))
    return last.where(F.col("last.op") != "d").select("key", "last.after.*")
