"""Half-precision .npy matrices by ranges of their rows: a data source that many tasks read, and a writer of many tasks.

The file is one header and rows of equal size, so a row's place is known. The source cuts the rows into ranges, each of
which a task reads alone; the writer counts the rows of each partition first, and the tasks put theirs behind those of the
partitions before, in a file of its full size that is renamed when all are in. Both reach the file as an ordinary one in a folder
that driver and executors share.
"""

from __future__ import annotations

import ast
import itertools
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docsift.session import checkpointed, importable
from docsift.sources.sinks import npy_header

RANGE_BYTES = 32 << 20
#: Rows that a task holds at a time.
BATCH = 4096


def local(path: str) -> str:
    """A path or file: address as a path."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def shape_of(path: str) -> tuple[int, int, int]:
    """(offset of the first row, rows, columns) from the header, which is version 1, 2 or 3."""
    with open(local(path), "rb") as f:
        start = f.read(12)
        if start[:6] != b"\x93NUMPY" or len(start) < 12:
            raise ValueError(f"{path} is no .npy file")
        size, at = (struct.unpack("<H", start[8:10])[0], 10) if start[6] == 1 else (struct.unpack("<I", start[8:12])[0], 12)
        f.seek(at)
        text = f.read(size)
    said = ast.literal_eval(text.decode("latin-1").strip())
    if said["descr"] not in ("<f2", "|f2") or said["fortran_order"] or len(said["shape"]) != 2:
        raise ValueError(f"{path} has no rows of half-precision numbers: {said}")
    offset, (rows, columns) = at + size, said["shape"]
    if os.path.getsize(local(path)) < offset + rows * columns * 2:
        raise ValueError(f"{path} is shorter than its header says")
    return offset, rows, columns


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.offset, self.rows, self.columns = shape_of(self.path)
        self.dimensions = min(int(options.get("dimensions", self.columns)), self.columns)
        self.step = max(1, int(options.get("rangebytes", RANGE_BYTES)) // max(1, 2 * self.columns))

    def partitions(self) -> list[InputPartition]:
        return [_Range(s, min(s + self.step, self.rows)) for s in range(0, self.rows, self.step)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(local(self.path), "rb") as f:
            f.seek(self.offset + partition.start * self.columns * 2)
            for start in range(partition.start, partition.end, BATCH):
                n = min(BATCH, partition.end - start)
                table = np.frombuffer(f.read(n * self.columns * 2), "<f2").reshape(n, self.columns)[:, : self.dimensions].astype("<f4")
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.dimensions)
                vectors = pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), vectors], names=["row", "vector"])


class HalfMatrix(DataSource):
    """Options: path; dimensions, the columns to take; rangebytes, what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "half_matrix"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_matrix(spark: SparkSession, path: str, dimensions: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row, vector) of the file, a task for each range of rows."""
    importable(spark)
    spark.dataSource.register(HalfMatrix)
    reader = spark.read.format("half_matrix").option("rangeBytes", range_bytes)
    return (reader if dimensions is None else reader.option("dimensions", dimensions)).load(path)


def write_matrix(vectors: DataFrame, path: str, dimensions: int, order: str, vector: str = "vector") -> tuple[int, int]:
    """Write the vectors in the order of a column, short ones filled with zeros, long ones cut; null ones are zeros. A file at
    path is replaced when the new one is whole. Returns rows and columns."""
    spark = vectors.sparkSession
    importable(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(vectors.select(order, F.col(vector).alias("vector")).repartitionByRange(n, order).sortWithinPartitions(order))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([total], pa.int64())})

    counts = sorted((r["part"], r["n"]) for r in placed.select(order).mapInArrow(count, "part int, n long").collect())  # a row for each partition
    starts = dict(zip((p for p, _ in counts), itertools.accumulate((c for _, c in counts), initial=0)))
    rows = sum(c for _, c in counts)
    header, target = npy_header(rows, dimensions), local(path)
    staged = f"{target}.{uuid.uuid4().hex}.next"
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with open(staged, "wb") as f:
        f.write(header)
        f.truncate(len(header) + rows * dimensions * 2)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = starts[TaskContext.get().partitionId()]
        with open(staged, "r+b") as f:
            f.seek(len(header) + at * dimensions * 2)
            for b in batches:
                for s in range(0, b.num_rows, BATCH):
                    own = b.column("vector").slice(s, BATCH).to_pylist()
                    table = np.zeros((len(own), dimensions), "<f2")
                    for i, v in enumerate(own):
                        if v:
                            table[i, : min(len(v), dimensions)] = v[:dimensions]
                    f.write(table.tobytes())
                    yield pa.RecordBatch.from_pydict({"n": pa.array([len(own)], pa.int64())})
            f.flush()
            os.fsync(f.fileno())

    try:
        written = placed.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if written != rows:
            raise OSError(f"{written} of {rows} rows were written")
        os.replace(staged, target)
    except BaseException:
        os.unlink(staged)
        raise
    return rows, dimensions
