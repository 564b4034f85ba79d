"""Stored results of micro-batches, merged by levels.

A part holds the rows of the batches from ``first`` to ``last`` in a folder named after both.  It counts
once Spark has marked it as complete, and then stands in for every part inside its range.  So a
merge switches over with that one mark: a job that ends while parts are merged leaves parts that
nobody reads and that the next merge writes again.  ``FANOUT`` parts of a level make one of the next,
so that files read grow with the logarithm of the batches.  Parts that others stand in for are kept
for readers that began before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FANOUT = 8


@dataclass
class BatchStore:
    """Parts under ``folder``; ``merge`` makes the rows of several parts into those of one."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    merge: Callable[[DataFrame], DataFrame]
    partition_by: tuple[str, ...] = ()
    fanout: int = FANOUT

    def _complete(self) -> list[tuple[int, int]]:
        """Ranges of all complete parts."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = []
        for entry in system.listStatus(path):
            own = entry.getPath()
            bounds = own.getName().removeprefix("part-").split("-")
            marked = system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS"))
            if own.getName().startswith("part-") and len(bounds) == 2 and marked:
                found.append((int(bounds[0]), int(bounds[1])))
        return found

    def parts(self) -> list[tuple[int, int]]:
        """The parts to read: complete, and inside no other one."""
        chosen: list[tuple[int, int]] = []
        for first, last in sorted(self._complete(), key=lambda part: (part[0], -part[1])):
            if not chosen or last > chosen[-1][1]:
                chosen.append((first, last))
        return chosen

    def _path(self, part: tuple[int, int]) -> str:
        return f"{self.folder}/part-{part[0]}-{part[1]}"

    def read(self, parts: list[tuple[int, int]] | None = None) -> DataFrame:
        parts = self.parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        frames = [self.spark.read.schema(self.schema).parquet(self._path(part)) for part in parts]
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows

    def _write(self, rows: DataFrame, part: tuple[int, int]) -> None:
        writer = rows.select(*self.schema.names).write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(self._path(part))

    def add(self, rows: DataFrame, number: int) -> None:
        """The rows of a batch.  A batch that is run again replaces its own, unless they are merged already."""
        if not any(first <= number <= last and last > first for first, last in self.parts()):
            self._write(rows, (number, number))
        self.compact()

    def compact(self) -> None:
        """Merges runs of ``fanout`` neighbouring parts of one level until there are none."""
        while True:
            parts = self.parts()
            run: list[tuple[int, int]] = []
            for part in reversed(parts):
                if run and _level(part, self.fanout) != _level(run[0], self.fanout):
                    break
                run.insert(0, part)
            if len(run) < self.fanout:
                return
            self._write(self.merge(self.read(run)), (run[0][0], run[-1][1]))


def _level(part: tuple[int, int], fanout: int) -> int:
    """How often parts of single batches were merged to make this one."""
    count, level = part[1] - part[0] + 1, 0
    while count >= fanout:
        count, level = count // fanout, level + 1
    return level
