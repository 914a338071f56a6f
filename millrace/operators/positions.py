"""Global order without a single-partition window.

A row's place in a total order is the number of rows in earlier buckets plus its
place inside its own bucket.  Buckets are given as ``levels``: columns from
coarse to fine that agree with the order.  Rows are shuffled once, by bucket;
only per-bucket totals are summed across buckets, level by level, and only the
totals of the coarsest level meet in one task.

Levels must be a pure function of the row, so that every attempt of every task
assigns the same bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits dropped from an id at each level: whatever the ids, at most 2**18 totals
# meet in one task, and no bucket holds more than 2**14 ids, since rows may carry
# whole token arrays.
ID_LEVEL_BITS = (48, 32, 14)


def id_levels(col: Column | str) -> list[Column]:
    """Levels for an integer order: ever narrower ranges down to blocks of ids."""
    col = F.col(col) if isinstance(col, str) else col
    col = F.coalesce(col.cast("long"), F.lit(-(2**63)))
    return [F.shiftright(col, bits) for bits in ID_LEVEL_BITS]


def hash_levels(col: Column | str, digits: int = 5) -> list[Column]:
    """Levels for a hexadecimal hash order: its first two, then ``digits`` digits."""
    return [F.substring(col, 1, 2), F.substring(col, 1, digits)]


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    """A reproducible random order key of a row: md5 of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def running_total(
    df: DataFrame,
    value: Column,
    levels: list[Column],
    order: list[Column],
    name: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one.

    The order is ``levels`` then ``order``, separately for each ``by`` group.
    ``order`` must break all ties.
    """
    by = by or []
    marks = [f"_level{i}" for i in range(len(levels))]
    marked = df.withColumns(dict(zip(marks, levels)) | {"_value": value.cast("long")})

    totals = marked.groupBy(*by, *marks).agg(F.sum("_value").alias("_total"))
    offsets = None
    for depth in range(len(marks), 0, -1):
        keys = by + marks[:depth]
        table = totals if depth == len(marks) else totals.groupBy(*keys).agg(
            F.sum("_total").alias("_total")
        )
        window = (
            Window.partitionBy(*keys[:-1])
            .orderBy(keys[-1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        before = F.coalesce(F.sum("_total").over(window), F.lit(0))
        table = table.select(*keys, before.alias(f"_before{depth}"))
        offsets = table if offsets is None else offsets.join(table, keys)
    before = reduce(lambda a, b: a + b, [F.col(f"_before{d + 1}") for d in range(len(marks))])
    offsets = offsets.select(*by, *marks, before.alias("_offset"))

    # The finest level leads, so that the sort is settled by its first column.
    bucket = [*reversed(marks), *by]
    inside = (
        Window.partitionBy(*bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return (
        marked.withColumn("_local", local)
        .join(offsets, bucket)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop(*marks, "_value", "_local", "_offset")
    )


def global_position(
    df: DataFrame,
    levels: list[Column],
    order: list[Column],
    name: str = "position",
    by: list[str] | None = None,
) -> DataFrame:
    """Add ``name``: dense positions 1..N in the order of ``levels`` then ``order``."""
    placed = running_total(df, F.lit(1), levels, order, name, by)
    return placed.withColumn(name, F.col(name) + 1)
