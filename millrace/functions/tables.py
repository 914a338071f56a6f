"""Lookups of whole token arrays in a small table, Arrow batch by Arrow batch.

Exploding tokens to join them one by one means regrouping every row afterwards.
For a table small enough to sit beside each task, one vectorised search per
batch does the same without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every Python worker holds the table, one copy per core, and indexes it anew for
# each Arrow batch.
WORKER_TABLE_BYTES = 32 * 1024 * 1024


def collected(table: DataFrame, column: str) -> pa.Array:
    """One column of a table already measured against the bound."""
    found = table.select(column).toArrow().column(0).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def positions_in(table: DataFrame, column: str) -> Callable[[Column], Column]:
    """From an array of strings to their row numbers in the table, NULL if absent."""
    values = table.sparkSession.sparkContext.broadcast(collected(table, column))

    @F.arrow_udf("array<int>")
    def positions(lists: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(lists.flatten(), value_set=values.value)
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), found)

    return lambda col: positions(F.coalesce(col, F.array().cast("array<string>")))


def values_at(table: DataFrame, column: str) -> Callable[[Column], Column]:
    """From an array of row numbers to the table's strings, NULL outside of it."""
    values = table.sparkSession.sparkContext.broadcast(collected(table, column))

    @F.arrow_udf("array<string>")
    def strings(lists: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lists.flatten()
        inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(values.value)))
        found = pc.take(values.value, pc.if_else(inside, flat, pa.scalar(None, flat.type)))
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), found)

    return lambda col: strings(F.coalesce(col, F.array().cast("array<int>")))


def filled(lists: Column, rest: Column, kind: str) -> Column:
    """``lists`` with their NULL elements replaced, in order, by the elements of ``rest``,
    which has one for each of them (NULL: none); both are arrays of ``kind``."""

    @F.arrow_udf(f"array<{kind}>")
    def fill(lists: pa.Array, rest: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = lists.flatten()
        found = pc.replace_with_mask(flat, pc.is_null(flat), rest.flatten().cast(flat.type))
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), found)

    return fill(lists, rest)
