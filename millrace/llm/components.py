"""Connected components by alternating large and small stars.

Every round rewrites the edges with two grouped minima, each followed by a join; a hub
is reduced by partial minima before the shuffle, and its edges are split by adaptive
execution in the join.  Rounds are written tables; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import cut_lineage, free_table


def star(edges: DataFrame) -> DataFrame:
    """Each edge ``(a, b)`` with ``low``: the smallest of ``b``s and ``a`` itself."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return edges.join(low, "a").select("a", "b", F.least("a", "low").alias("low"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    return star(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node to the smaller one."""
    found = star(edges)
    moved = found.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(found.select("a", F.col("low").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes of ``edges (a, b)``: the smallest node reached.

    Edges go either way; loops, nulls and repeated edges do not matter.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.distinct(), "edges")
    state = None
    while True:
        rounded = small_star(large_star(edges).distinct()).where("a != b").distinct()
        rounded = cut_lineage(rounded, "edges")
        new = rounded.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        free_table(edges)
        edges = rounded
        if tuple(new) == state:
            break
        state = tuple(new)
    centres = edges.select(F.col("b").alias("a"), "b").distinct()
    return edges.union(centres).select(F.col("a").alias("node"), F.col("b").alias("component"))


def keep_firsts(documents: DataFrame, placed: DataFrame) -> DataFrame:
    """``documents`` whose id is that of their component in ``placed (doc_id, component_id)``.

    Rows that share an id are one document: they stay or go together.
    """
    first = placed.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut_lineage(first.select(F.col("doc_id").alias("kept_id")).distinct(), "kept")
    rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("kept_id"))
    return rows.join(kept.hint("shuffle_hash"), same, "left_semi").select("doc.*")
