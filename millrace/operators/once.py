"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are not evaluated again by later steps.

    A filter on a projected column is moved below the projection and repeats its
    expression; it cannot pass the generator used here.
    """
    kept = [c for c in df.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    order = df.columns + [c for c in columns if c not in df.columns]
    return df.select(*kept, F.inline(F.array(values))).select(*order)
