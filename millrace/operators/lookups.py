"""Left joins of large fact tables with dimension tables of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 256 * 1024 * 1024
LEAST_ROW_BYTES = 8


def fits_broadcast(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a written table against the broadcast bound.

    The row count, which Parquet keeps in its footers, settles most large tables.
    """
    if table.count() * LEAST_ROW_BYTES > max_bytes:
        return False
    return table_bytes(table) <= max_bytes


def table_bytes(table: DataFrame) -> int:
    """The size of a table, its rows as JSON."""
    return table.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def leading_rows(table: DataFrame, max_bytes: int) -> tuple[int, int]:
    """How many of the first rows of a written table fit the bound, by their mean size,
    and how many there are."""
    rows, size = table.count(), table_bytes(table)
    return (rows if size <= max_bytes else rows * max_bytes // size), rows


def lookup(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    hot: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left join ``facts`` with a written ``table`` that is unique on ``on``.

    A table measured within the bound is broadcast and the facts stay in place.
    Beyond it:

    - ``hot`` marks the rows of the table most facts ask for.  They are broadcast
      and only facts without a match there are shuffled to the rest.
    - Otherwise both sides are shuffled once, the table without copies, and adaptive
      execution splits the partitions of hot keys.
    """
    if fits_broadcast(table, max_bytes):
        return facts.join(F.broadcast(table), on, "left")
    if hot is not None:
        near = table.where(hot)
        if fits_broadcast(near, max_bytes):
            marked = near.withColumn("_found", F.lit(True))
            first = facts.join(F.broadcast(marked), on, "left")
            # Rows with a NULL key match nothing and need not travel either.
            settled = F.col("_found").isNotNull() | reduce(
                lambda a, b: a | b, [F.col(c).isNull() for c in on]
            )
            missed = first.where(~settled).select(*facts.columns)
            late = missed.join(table.where(~hot), on, "left")
            return first.where(settled).drop("_found").unionByName(late)
    return facts.join(table, on, "left")
