"""Ordered groups in blocks: what needs the rows of a group in order, without a task that holds a whole group.

Rows are dealt by range over (group, order), so that a group with a third of all rows lies in many tasks, one after
the other. Each partition is a block; it is stored once, so that two passes see the same blocks. The first pass sums up
the first and the last group of each block, the only ones that can go on in a neighbour; what reaches the driver is two
small records for each partition, however many rows or groups there are. The second pass gets what stands before its
block and needs nothing else of other blocks. `spark.sql.shuffle.partitions` sizes the blocks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docsift.llm.common import checkpointed, ship


def sorted_blocks(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows in order of (group, order), nulls first, stored in the shared folder with their partitions."""
    ship(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order))


def runs(table: pa.Table, group: str) -> list[tuple[Any, int, int]]:
    """(group value, start, end) of each group of a sorted table of integer groups."""
    if not table.num_rows:
        return []
    column = table.column(group).combine_chunks()
    null = column.is_null().to_numpy(zero_copy_only=False)
    value = column.fill_null(0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1
    starts = [0, *cuts.tolist()]
    return [(None if null[s] else int(value[s]), s, e) for s, e in zip(starts, [*starts[1:], table.num_rows])]


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def edges(blocks: DataFrame, group: str, prepare: Callable[[pa.Table], Any], summary: Callable[[Any, int, int], Any]) -> list[tuple[int, list[tuple[Any, Any]]]]:
    """For each block, in order: its number and (group, summary of its rows) of its first group and, if it is another
    one, of its last. prepare turns a block's table into what summary takes, with the first and last place of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        if table is not None:
            found, block = runs(table, group), prepare(table)
            ends = [found[0]] + ([found[-1]] if len(found) > 1 else [])
            said = json.dumps([(g, summary(block, s, e)) for g, s, e in ends])
            yield pa.RecordBatch.from_pydict({"block": [TaskContext.get().partitionId()], "ends": [said]}, schema=pa.schema([("block", pa.int32()), ("ends", pa.string())]))

    rows = blocks.mapInArrow(run, "block int, ends string").collect()  # one row for each partition
    return sorted((r["block"], [(g, x) for g, x in json.loads(r["ends"])]) for r in rows)


def chains(found: list[tuple[int, list[tuple[Any, Any]]]]) -> list[list[tuple[int, Any]]]:
    """Groups that go over several blocks: for each, (block, summary) in order."""
    out: list[list[tuple[int, Any]]] = []
    running: tuple[Any, list[tuple[int, Any]]] | None = None
    for block, ends in found:
        group, said = ends[0]
        if running and running[0] == group:
            running[1].append((block, said))
        else:
            running = (group, [(block, said)])
            out.append(running[1])
        if len(ends) > 1:
            running = (ends[1][0], [(block, ends[1][1])])
            out.append(running[1])
    return [c for c in out if len(c) > 1]


def each_group(blocks: DataFrame, group: str, prepare: Callable[[pa.Table], Any], work: Callable[[int, Any, bool, bool, Any, int, int], list[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """The rows of work(block number, group value, is first, is last, prepared block, start, end) for every group of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = whole(batches)
        if table is None:
            return
        number, found, block = TaskContext.get().partitionId(), runs(table, group), prepare(table)
        made: list[tuple] = []
        for k, (g, s, e) in enumerate(found):
            made += work(number, g, k == 0, k == len(found) - 1, block, s, e)
            if len(made) >= 5_000 or k == len(found) - 1 and made:
                yield batch_of(made, arrow)
                made = []

    return blocks.mapInArrow(run, schema)


def batch_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
