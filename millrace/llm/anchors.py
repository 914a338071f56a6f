"""Anchored windows: repeats of fixed-length windows without a row per window.

Every window of ``length`` units (bytes or words) chooses an anchor inside itself by its
content alone, so equal windows choose the same anchor at the same place.  The windows of
a document that share an anchor are one row: the anchor's name ``gram``, the first window
``lo``, their number ``m``, the anchor's place ``off`` after ``lo``, and ``context``, a hash
of everything the windows cover.

Equal ``(gram, context)`` means that all of the row's windows are equal; one name with
several contexts means that some may be.  Both are settled by grouped minima over names,
so a passage in a third of all documents is one partial row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import Texts, mix, slices
from millrace.sources.scratch import cut_lineage

#: Bits of a place inside a slice in the keys that order anchors; the rest is hash.
PLACE_BITS = 31

ANCHOR_FIELDS = "gram long, context long, id long, mark int, again boolean, lo int, m int, off int"

#: Finds anchors in a slice: names, text, first window, number of windows, place after
#: it, and the context hash; places count from the start of the text.
Finder = Callable[[Texts], tuple[np.ndarray, ...]]


def keyed(documents: DataFrame) -> DataFrame:
    """``(doc_id, id, mark, text)``: ``id`` orders documents (null first); ``mark`` tells
    apart the texts of rows that share an id."""
    return documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        F.hash("text").alias("mark"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def order_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys that order by hash, then place."""
    bits = np.uint64(PLACE_BITS)
    return (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)


def place_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(2**PLACE_BITS - 1)).astype(np.int64)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours, by doubling."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def group_windows(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First of each run of windows ``at`` that follow each other and agree in ``same``
    (text and anchor), and the run's length."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for values in same:
        new[1:] |= values[1:] != values[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def anchor_batch(rows: pa.RecordBatch, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Anchor rows of a slice.  A row that repeats an earlier one of its document is
    marked ``again``; such rows that follow each other become one."""
    gram, text, lo, m, off, context = found
    same = mix(gram ^ mix(context ^ mix(text.astype(np.uint64))))
    order = np.argsort(same, kind="stable")
    repeat = np.zeros(len(same), bool)
    repeat[order[1:]] = same[order[1:]] == same[order[:-1]]
    follows = np.zeros(len(same), bool)
    follows[1:] = repeat[1:] & repeat[:-1] & (text[1:] == text[:-1]) & (lo[1:] == lo[:-1] + m[:-1])
    first = np.flatnonzero(~follows)
    m = np.add.reduceat(m, first) if len(first) else m
    ids = rows.column("id").to_numpy()[text[first]]
    marks = rows.column("mark").to_numpy()[text[first]]
    columns = (
        gram[first].view(np.int64), context[first].view(np.int64), ids, marks,
        repeat[first], lo[first].astype(np.int32), m.astype(np.int32), off[first].astype(np.int32),
    )
    names = [field.split()[0] for field in ANCHOR_FIELDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def anchors(rows: DataFrame, find: Finder) -> DataFrame:
    """The anchor rows of ``keyed`` documents."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                yield anchor_batch(texts.rows, find(texts))

    return rows.select("id", "mark", "text").mapInArrow(search, ANCHOR_FIELDS)


def repeated_anchors(rows: DataFrame, find: Finder) -> DataFrame:
    """Anchor rows whose name occurs more than once, as a written table."""
    found = anchors(rows, find)
    names = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    return cut_lineage(found.join(names.hint("shuffle_hash"), "gram", "left_semi"), "anchors")


def settled(repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose windows all occur earlier, and rows that only a look at single windows
    can settle: the first of each context of names with several contexts."""
    classes = repeated.where("NOT again").groupBy("gram", "context").agg(F.min("id").alias("first"))
    mixed = classes.groupBy("gram").agg((F.count(F.lit(1)) > 1).alias("mixed"))
    placed = repeated.join(classes, ["gram", "context"]).join(mixed, "gram")
    placed = cut_lineage(
        placed.select(
            "id", "mark", "gram", "lo", "m", "off",
            (F.col("again") | (F.col("id") > F.col("first"))).alias("later"),
            "mixed",
        ).where("later OR mixed"),
        "settled",
    )
    later = placed.where("later").select("id", "mark", "lo", "m")
    return later, placed.where("NOT later").select("id", "mark", "gram", "lo", "m", "off")


def by_document(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """``rows`` of the documents that have ``found`` rows, these as the list ``found``."""
    lists = found.groupBy("id", "mark").agg(F.collect_set(F.struct(*columns)).alias("found"))
    return rows.join(lists.hint("shuffle_hash"), ["id", "mark"])


def found_ranges(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window and number of windows of the lists ``found`` of a batch."""
    lists = rows.column("found")
    flat = lists.flatten()
    count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(lists)), count)
    return text, *(flat.field(c).to_numpy().astype(np.int64) for c in ("lo", "m"))


def earlier_elsewhere(single: DataFrame) -> DataFrame:
    """``(id, mark, lo, m)`` of the windows ``(h1, h2, id, mark, lo, again)`` that are in
    a document with a smaller id, or ``again`` in their own."""
    firsts = single.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = single.join(firsts.where("n > 1"), ["h1", "h2"]).where("again OR id > first")
    return repeats.select("id", "mark", "lo", F.lit(1).alias("m"))


def covered(first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` units some of the ranges cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + count, -1)
    return np.cumsum(edge[:-1]) > 0
