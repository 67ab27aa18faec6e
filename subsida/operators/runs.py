"""Groups of rows for Python: many whole groups a call, in the order of their keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from subsida.operators.storage import shuffle_partitions


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The first row of every run of equal keys."""
    new = np.ones(table.num_rows, dtype=bool)
    if table.num_rows > 1:
        new[1:] = False
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= (c[1:] != c[:-1]) & ~((c[1:] != c[1:]) & (c[:-1] != c[:-1]))  # NaN is NaN
    return np.flatnonzero(new)


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn over tables of whole groups, sorted by keys and `order`; a task holds one Arrow batch and its longest group.

    Partitions are as many as the session has for shuffles: few bytes may be much work, and Spark would join them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            ends = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b] if held else [b])
            at = starts(ends, keys)
            at = at[at > 0] - 1 if held else at
            if held and not len(at):  # nothing but the group at hand
                held.append(b)
                continue
            last = int(at[-1])
            whole = held + ([b.slice(0, last)] if last else [])
            if whole:
                yield from fn(pa.Table.from_batches(whole).combine_chunks()).to_batches()
            held = [b.slice(last)]
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
