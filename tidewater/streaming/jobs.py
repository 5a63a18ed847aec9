"""Jobs: named queries with a checkpoint, which can be suspended, resumed, restarted, cancelled, and copied as snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class JobConfig:
    name: str
    checkpoint: str
    #: "update" gives early results of open windows, "append" final ones only.
    mode: str = "append"
    #: None: as fast as it goes; else a trigger every so many milliseconds.
    interval_ms: int | None = None
    #: Ends when all that was there at the start is done.
    available_now: bool = False
    initial_snapshot: str | None = None
    suspend_on_failure: bool = False


@dataclass
class Job:
    spark: SparkSession
    config: JobConfig
    make: Callable[[], DataFrame]
    each: Callable[[DataFrame, int], Any] | None
    query: Any = None
    state: str = "NOT_RUNNING"
    submitted: float = field(default_factory=time.time)

    def start(self) -> Job:
        c = self.config
        writer = self.make().writeStream.queryName(c.name).outputMode(c.mode).option("checkpointLocation", c.checkpoint)
        writer = writer.foreachBatch(self.each) if self.each else writer.format("memory")
        if c.available_now:
            writer = writer.trigger(availableNow=True)
        elif c.interval_ms is not None:
            writer = writer.trigger(processingTime=f"{c.interval_ms} milliseconds")
        self.query = writer.start()
        self.state = "RUNNING"
        return self

    def status(self) -> str:
        if self.state == "RUNNING" and self.query is not None and not self.query.isActive:
            if self.query.exception() is None:
                self.state = "COMPLETED"
            else:
                self.state = "SUSPENDED" if self.config.suspend_on_failure else "FAILED"
        return self.state

    def suspension_cause(self) -> str | None:
        failed = self.query is not None and self.query.exception()
        return str(failed) if failed else "requested" if self.state == "SUSPENDED" else None

    def metrics(self) -> dict | None:
        last = self.query.lastProgress if self.query else None
        return dict(last) if last else None

    def suspend(self) -> None:
        self.query.stop()
        self.state = "SUSPENDED"

    def resume(self) -> None:
        if self.status() != "SUSPENDED":
            raise ValueError(f"job {self.config.name} is {self.state}")
        self.start()

    def restart(self) -> None:
        if self.query.isActive:
            self.query.stop()
        self.start()

    def cancel(self) -> None:
        if self.query is not None and self.query.isActive:
            self.query.stop()
        self.state = "CANCELLED"

    def join(self, timeout_s: float | None = None) -> bool:
        ended = self.query.awaitTermination(timeout_s) if timeout_s is not None else self.query.awaitTermination()
        self.status()
        return ended is None or bool(ended)

    def export_snapshot(self, path: str) -> None:
        """Copies the checkpoint. Between micro-batches it is whole: a running query is paused for the copy."""
        running = self.query.isActive
        if running:
            self.query.processAllAvailable()
            self.query.stop()
        _copy(self.spark, self.config.checkpoint, path)
        if running:
            self.start()

    def cancel_and_export(self, path: str) -> None:
        self.cancel()
        _copy(self.spark, self.config.checkpoint, path)


def _copy(spark: SparkSession, a: str, b: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    one, two = hadoop.Path(a), hadoop.Path(b)
    two.getFileSystem(conf).delete(two, True)
    hadoop.FileUtil.copy(one.getFileSystem(conf), one, two.getFileSystem(conf), two, False, conf)


class Jobs:
    """The jobs of a session, by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.by_name: dict[str, Job] = {}

    def submit(self, config: JobConfig, make: Callable[[], DataFrame], each: Callable[[DataFrame, int], Any] | None = None) -> Job:
        if (old := self.by_name.get(config.name)) and old.status() in ("RUNNING", "SUSPENDED"):
            raise ValueError(f"job {config.name} exists")
        if config.initial_snapshot:
            _copy(self.spark, config.initial_snapshot, config.checkpoint)
        job = self.by_name[config.name] = Job(self.spark, config, make, each)
        return job.start()

    def submit_if_absent(self, config: JobConfig, make, each=None) -> Job:
        old = self.by_name.get(config.name)
        return old if old and old.status() in ("RUNNING", "SUSPENDED") else self.submit(config, make, each)

    def get(self, name: str) -> Job:
        if name not in self.by_name:
            raise KeyError(f"no job {name}")
        return self.by_name[name]

    def names(self) -> list[str]:
        return sorted(n for n, j in self.by_name.items() if j.status() in ("RUNNING", "SUSPENDED"))
