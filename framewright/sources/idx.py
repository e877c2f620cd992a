"""IDX images as a data source: a file is read by many tasks, each the bytes of its rows.

    spark.dataSource.register(IdxImages)
    spark.read.format("idx_images").option("images", path).option("labels", path).load().where("row_id < 1000")

The header gives the number and size of images, from which byte ranges follow; a filter on row_id (=, <, <=, >, >=, in) narrows them, so that
other rows' bytes aren't read. A path is a local one or a URI that Arrow's file systems open (file, s3, gs, hdfs), on the driver and on the
executors. Compressed files have no byte ranges: `frames.read_idx` reads them whole.

(row_id, x, label): pixels in 0..1. A file that isn't IDX of unsigned bytes, that is cut off, or whose labels aren't as many as its
images is an error; a file of no images gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from framewright.shipping import ship

ROWS_PER_TASK, ROWS_PER_BATCH = 20_000, 2000
PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str):
    """A file for reading at any place."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def header(path: str) -> tuple[tuple[int, ...], int]:
    """(sizes, place of the first byte of data)."""
    with opened(path) as f:
        size, start = f.size(), f.read_at(min(4, f.size()), 0)
        if start[:2] == b"\x1f\x8b":
            raise ValueError(f"{path} is compressed: it can't be read by ranges")
        if len(start) < 4 or start[:2] != b"\0\0" or start[2] != 8:
            raise ValueError(f"{path} isn't an IDX file of unsigned bytes")
        n = start[3]
        shape = struct.unpack(f">{n}I", f.read_at(4 * n, 4)) if size >= 4 + 4 * n else ()
        if len(shape) != n or size != 4 + 4 * n + int(np.prod(shape, dtype=np.int64)):
            raise ValueError(f"{path} is cut off or longer than its header says")
    return shape, 4 + 4 * n


class Rows(InputPartition):
    """Rows from `lo` to `hi`, without the latter."""

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class IdxReader(DataSourceReader):
    def __init__(self, images: str, labels: str, rows_per_task: int):
        self.images, self.labels, self.rows_per_task = images, labels, rows_per_task
        self.lo, self.hi, self.only = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("row_id",) or not self._take(f):
                yield f

    def _take(self, f) -> bool:
        """Narrow the rows by one filter; whether that was all it says."""
        top = lambda n: n if self.hi is None else min(self.hi, n)
        if isinstance(f, IsNotNull):
            return True
        values = getattr(f, "value", None)
        if not all(type(v) is int for v in (values if isinstance(f, In) else [values])):
            return False
        if isinstance(f, (EqualTo, In)):
            wanted = set(values) if isinstance(f, In) else {values}
            self.only = wanted if self.only is None else self.only & wanted
        elif isinstance(f, GreaterThan):
            self.lo = max(self.lo, values + 1)
        elif isinstance(f, GreaterThanOrEqual):
            self.lo = max(self.lo, values)
        elif isinstance(f, LessThan):
            self.hi = top(values)
        elif isinstance(f, LessThanOrEqual):
            self.hi = top(values + 1)
        else:
            return False
        return True

    def partitions(self) -> list[InputPartition]:
        (n, *_), _ = header(self.images)
        if header(self.labels)[0] != (n,):
            raise ValueError(f"{self.labels} hasn't a label for each of {n} images")
        lo, hi = self.lo, n if self.hi is None else min(self.hi, n)
        if self.only is None:
            return [Rows(a, min(a + self.rows_per_task, hi)) for a in range(lo, hi, self.rows_per_task)] or [Rows(0, 0)]
        out: list[Rows] = []
        for row in sorted(r for r in self.only if lo <= r < hi):  # neighbours are one range
            if out and out[-1].hi == row and row - out[-1].lo < self.rows_per_task:
                out[-1].hi += 1
            else:
                out.append(Rows(row, row + 1))
        return out or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        (_, *sides), first = header(self.images)
        _, first_label = header(self.labels)
        size = int(np.prod(sides, dtype=np.int64))
        with opened(self.images) as images, opened(self.labels) as labels:
            for a in range(partition.lo, partition.hi, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.hi - a)
                x = np.frombuffer(images.read_at(n * size, first + a * size), np.uint8).astype(np.float64) / 255.0
                y = np.frombuffer(labels.read_at(n, first_label + a), np.uint8)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x), size).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), lists, pa.array(y.astype(np.int32))], names=["row_id", "x", "label"])


class IdxImages(DataSource):
    """Options: images, labels, rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "idx_images"

    def schema(self) -> str:
        return "row_id long, x array<double>, label int"

    def reader(self, schema) -> DataSourceReader:
        missing = [o for o in ("images", "labels") if not self.options.get(o)]
        if missing:
            raise ValueError(f"the option {missing[0]} is missing")
        return IdxReader(self.options["images"], self.options["labels"], max(1, int(self.options.get("rowspertask", ROWS_PER_TASK))))


def read(spark: SparkSession, images: str, labels: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Image frames (row_id, x, label). Filters reach Python sources only with a session setting, which is made here."""
    ship(spark)
    spark.conf.set(PUSH_DOWN, "true")
    spark.dataSource.register(IdxImages)
    return spark.read.format("idx_images").option("images", images).option("labels", labels).option("rowsPerTask", rows_per_task).load()
