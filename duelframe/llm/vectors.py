"""Vector columns: which vectors count, equal ones as one class, and runs of sorted rows inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def product(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], key: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows with equal ``key`` (a long, sorted in the task), at most ``limit`` at a time."""
    held: list[pa.RecordBatch] = []
    rows, at = 0, None

    def together() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if held and keys[begin] != at:
                yield together()
                held, rows = [], 0
            at = keys[begin]
            while begin < end:
                take = min(end - begin, limit - rows)
                held.append(batch.slice(begin, take))
                rows += take
                begin += take
                if rows == limit:
                    yield together()
                    held, rows = [], 0
    if held:
        yield together()


def numbers(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    """A record batch of number columns named as in ``schema`` (a list of names)."""
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.split())


def in_runs(df: DataFrame, key: str, *within: str) -> DataFrame:
    """Rows with equal ``key`` in one task and next to each other."""
    return df.repartition(key).sortWithinPartitions(key, *within)
