"""A stream of the lines that are added to files of a folder, new files and old ones, as a data source of Spark's own API.

An offset is how many bytes of each file have been read; a line counts once it has ended. Ranges of bytes are read in the executors, so the folder
must be one that the driver and all executors see at the same path. Files that shrink are read again from their start.
"""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that a task reads.
RANGE = 32 << 20


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def last_line_end(path: str, low: int, high: int, step: int = 1 << 16) -> int:
    """The place after the last line feed of the bytes from low to high; low if there is none."""
    with open(path, "rb") as f:
        while high > low:
            at = max(low, high - step)
            f.seek(at)
            found = f.read(high - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            high = at
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*")
        self.charset = options.get("charset", "utf-8")
        self.from_end = options.get("from", "start") == "end"
        self.seen: dict[str, int] = {}

    def _ends(self, before: dict[str, int]) -> dict[str, int]:
        out = {}
        for e in os.scandir(self.folder) if os.path.isdir(self.folder) else ():
            if e.is_file() and fnmatch.fnmatch(e.name, self.glob):
                size = e.stat().st_size
                at = before.get(e.name, 0)
                out[e.name] = last_line_end(e.path, at if at <= size else 0, size)
        return out

    def initialOffset(self) -> dict:
        return self._ends({}) if self.from_end else {}

    def latestOffset(self) -> dict:
        self.seen = self._ends(self.seen)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, high in sorted(end.items()):
            low = start.get(name, 0) if start.get(name, 0) <= high else 0
            path = os.path.join(self.folder, name)
            while low < high:
                cut = high if high - low <= RANGE else last_line_end(path, low, low + RANGE)
                cut = high if cut == low else cut  # one line is longer than a range
                out.append(Range(path, low, cut))
                low = cut
        return out

    def read(self, partition: Range):
        with open(partition.path, "rb") as f:
            f.seek(partition.low)
            data = f.read(partition.high - partition.low)
        name = os.path.basename(partition.path)
        for line in data.split(b"\n")[:-1]:
            yield (name, line.rstrip(b"\r").decode(self.charset, "replace"))


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewater-tail"

    def schema(self) -> str:
        return "file_name string, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
