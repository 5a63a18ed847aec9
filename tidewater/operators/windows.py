"""Event-time windows over batch and streaming DataFrames: the same expressions serve both."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowDefinition:
    """Lengths in milliseconds. early: every so many milliseconds open windows are given out too, marked as early."""

    kind: str
    size: int
    step: int
    early: int = 0

    def with_early_results(self, period_ms: int) -> WindowDefinition:
        return replace(self, early=period_ms)

    def column(self, ts: Column) -> Column:
        if self.kind == "session":
            # Spark merges sessions that touch; a gap of the timeout itself must not
            return F.session_window(ts, F.lit(f"{self.size * 1000 - 1} microseconds"))
        return F.window(ts, f"{self.size} milliseconds", f"{self.step} milliseconds")

    def bounds(self, window: str = "__window") -> list[Column]:
        end = F.col(f"{window}.end")
        if self.kind == "session":
            end = F.timestamp_micros(F.unix_micros(end) + 1)
        return [F.col(f"{window}.start").alias("window_start"), end.alias("window_end")]


def tumbling(size_ms: int) -> WindowDefinition:
    return sliding(size_ms, size_ms)


def sliding(size_ms: int, step_ms: int) -> WindowDefinition:
    if size_ms <= 0 or step_ms <= 0 or size_ms % step_ms:
        raise ValueError("the step must divide the size")
    return WindowDefinition("sliding", size_ms, step_ms)


def session(timeout_ms: int) -> WindowDefinition:
    if timeout_ms <= 0:
        raise ValueError("the timeout must be positive")
    return WindowDefinition("session", timeout_ms, timeout_ms)
