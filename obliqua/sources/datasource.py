"""Image files as a Spark data source: ``spark.read.format("obliqua_image").load(path)``.

Ranges of t, c, z, y and x in a query's filters are pushed into the reader: pieces of the file outside them are not opened, and
what comes back lies within them.  Files lie in a folder that all executors share; the list of pieces is read
when a query is planned, and its tasks read the pixels.

Options: ``path``; ``scene`` (CZI, default 0); ``image_id`` (default 0); ``task_bytes``, about the pixels of one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .layouts import AXES, Layout, open_layout

NAME = "obliqua_image"
VOXELS = "image_id int, t int, c int, z int, y int, x int, v double"
TASK_BYTES = 16 << 20
MOST_ROWS = 1 << 18


@dataclass
class Task(InputPartition):
    work: Any


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.scene = options["path"], int(options.get("scene", 0))
        self.image_id, self.task_bytes = int(options.get("image_id", 0)), int(options.get("task_bytes", TASK_BYTES))
        self.bounds = {k: (0, 1 << 31) for k in AXES}
        self.wanted = True
        self._opened: Layout | None = None

    def _narrow(self, axis: str, low: int | None = None, high: int | None = None) -> None:
        a, b = self.bounds[axis]
        self.bounds[axis] = (a if low is None else max(a, low), b if high is None else min(b, high))

    def _take(self, one: Filter) -> bool:
        """Whether a filter is dealt with here as a whole."""
        if isinstance(one, IsNotNull):
            return True  # no column has nulls
        name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
        if name == "image_id" and isinstance(one, EqualTo) and isinstance(one.value, int):
            self.wanted = self.wanted and one.value == self.image_id
            return True
        if name not in AXES:
            return False
        if isinstance(one, In):
            if not one.value or not all(isinstance(n, int) for n in one.value):
                return False
            self._narrow(name, min(one.value), max(one.value) + 1)
            return False  # gaps within the range are left to Spark
        if not isinstance(getattr(one, "value", None), int):
            return False
        if isinstance(one, EqualTo):
            self._narrow(name, one.value, one.value + 1)
        elif isinstance(one, GreaterThan):
            self._narrow(name, low=one.value + 1)
        elif isinstance(one, GreaterThanOrEqual):
            self._narrow(name, low=one.value)
        elif isinstance(one, LessThan):
            self._narrow(name, high=one.value)
        elif isinstance(one, LessThanOrEqual):
            self._narrow(name, high=one.value + 1)
        else:
            return False
        return True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self._take(f)]

    def layout(self) -> Layout:
        if self._opened is None:
            found = open_layout(self.path, self.scene)
            if found is None:
                raise ValueError(f"{self.path}: a file of this name is not read")
            self._opened = found
        return self._opened

    def __getstate__(self) -> dict[str, Any]:
        """What goes to the tasks: the layout without its list of pieces, as each task has its own with it."""
        return self.__dict__ | {"_opened": replace(self.layout(), pieces=[])}

    def partitions(self) -> list[InputPartition]:
        if not self.wanted or any(a >= b for a, b in self.bounds.values()):
            return []
        return [Task(work) for work in self.layout().tasks(self.bounds, self.task_bytes)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing met the ranges
            return
        for start, block in self.layout().blocks(partition.work, self.bounds):
            low = [max(0, self.bounds[k][0] - s) for k, s in zip(AXES, start, strict=True)]
            cut = block[tuple(slice(a, max(a, self.bounds[k][1] - s)) for a, k, s in zip(low, AXES, start, strict=True))]
            places = np.nonzero(cut)
            for first in range(0, len(places[0]), MOST_ROWS):
                some = tuple(p[first : first + MOST_ROWS] for p in places)
                columns = [pa.array(np.full(len(some[0]), self.image_id, np.int32)), *[pa.array((p + a + s).astype(np.int32)) for p, a, s in zip(some, low, start, strict=True)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cut[some].astype(np.float64))], names=["image_id", *AXES, "v"])


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageSource)


def read_image(spark: SparkSession, path: str, scene: int = 0, image_id: int = 0) -> DataFrame:
    """The voxels above or below 0 of a file."""
    register(spark)
    return spark.read.format(NAME).option("scene", scene).option("image_id", image_id).load(path)
