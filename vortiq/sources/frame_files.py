"""Frame files as a data source: spark.read.format("velocity_frames").option("columns", 640).load(folder).

A partition is a run of files. Conditions on frame_no choose files before any is opened, those on j and i choose lines
before their numbers are read; both need spark.sql.python.filterPushdown.enabled. Folders may be of any store that
pyarrow's file systems reach. Files are as sources.tecplot describes them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .tecplot import HEADER

SCHEMA = "path string, frame_no long, j int, i int, x_mm double, y_mm double, u float, v float, valid boolean"
TESTS = {
    EqualTo: lambda a, b: a == b,
    EqualNullSafe: lambda a, b: a == b,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
    In: lambda a, b: np.isin(a, list(b)),
}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def frame_of(path: str) -> int | None:
    """The digits before the extension."""
    found = re.search(r"(\d+)\.[^./]*$", path)
    return int(found[1]) if found else None


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.columns = options["path"], int(options["columns"])
        self.suffix, self.run = options.get("suffix", ".dat"), int(options.get("filesPerPartition", 16))
        self.held: dict[str, list[tuple[type, object]]] = {"frame_no": [], "j": [], "i": []}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Comparisons of frame_no, j and i with values are settled here, all others stay with Spark."""
        for one in filters:
            name = one.attribute[0] if hasattr(one, "attribute") and len(one.attribute) == 1 else None
            if type(one) in TESTS and name in self.held and getattr(one, "value", None) is not None:
                self.held[name].append((type(one), one.value))
            else:
                yield one

    def _fits(self, name: str, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for kind, value in self.held[name]:
            out &= TESTS[kind](values, value)
        return out

    def partitions(self) -> list[InputPartition]:
        system, folder = _opened(self.folder)
        found = [f.path for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.is_file and f.path.endswith(self.suffix)]
        numbered = sorted((frame_of(p), p) for p in found if frame_of(p) is not None)
        kept = self._fits("frame_no", np.array([n for n, _ in numbered], np.int64)) if numbered else []
        paths = [p for (_, p), ok in zip(numbered, kept) if ok]
        return [Files(tuple(paths[k : k + self.run])) for k in range(0, len(paths), self.run)] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                yield self._batch(path, f.readall().decode())

    def _batch(self, path: str, text: str) -> pa.RecordBatch:
        lines = [x for x in text.splitlines() if x.strip()][HEADER:]
        at = np.arange(len(lines))
        j, i = at // self.columns + 1, at % self.columns + 1
        kept = np.flatnonzero(self._fits("j", j) & self._fits("i", i))
        cells = [re.split(r"[\s,]+", lines[k].strip()) for k in kept]

        def number(k: int) -> list[float | None]:
            out = []
            for c in cells:
                try:
                    out.append(float(c[k]))
                except (IndexError, ValueError):
                    out.append(None)
            return out

        flags = [None if x is None else x > 0 for x in number(4)]
        n = len(kept)
        columns = [pa.array([path] * n, pa.string()), pa.array([frame_of(path)] * n, pa.int64()), pa.array(j[kept], pa.int32()), pa.array(i[kept], pa.int32()), pa.array(number(0), pa.float64()), pa.array(number(1), pa.float64()), pa.array(number(2), pa.float32()), pa.array(number(3), pa.float32()), pa.array(flags, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


class FrameFiles(DataSource):
    """Options: path; columns, points in a row; suffix (.dat); filesPerPartition (16)."""

    @classmethod
    def name(cls) -> str:
        return "velocity_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameFiles)
