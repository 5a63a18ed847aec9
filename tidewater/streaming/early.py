"""Early results of windows: what open windows hold so far, marked, and each window's final result once.

Spark gives a query one output mode, so there are two queries over the same plan, each with its own checkpoint: one updates as
rows come, one appends as windows close.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.stage import Stage


@dataclass
class EarlyResults:
    early: Any
    final: Any

    def stop(self) -> None:
        self.early.stop()
        self.final.stop()

    def process_all(self) -> None:
        self.early.processAllAvailable()
        self.final.processAllAvailable()


def start_with_early_results(stage: Stage, each: Callable[[DataFrame], Any], checkpoint: str, period_ms: int | None = None) -> EarlyResults:
    """each gets rows with ``is_early``: at most every period_ms those of windows that changed, and final ones as windows close. The period is by
    default that of the window's with_early_results."""
    period_ms = period_ms or stage.early_ms
    if not period_ms:
        raise ValueError("the window has no early results, and no period is given")

    def run(mode: str, early: bool):
        writer = stage.df.writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/{mode}")
        writer = writer.foreachBatch(lambda df, _: each(df.withColumn("is_early", F.lit(early))))
        return (writer.trigger(processingTime=f"{period_ms} milliseconds") if early else writer).start()

    return EarlyResults(run("update", True), run("append", False))
