"""Substring dedup on bytes: sparse suffixes, deep-shallow sorting.

Whole suffix arrays of a corpus do not fit a shuffle, and need not: only equal strings of
``LENGTH`` bytes matter.  Each such window chooses the k-byte gram of least hash inside
it as its anchor (see ``anchors``); grams met once, and contexts met whole, are settled
by names.  What is left are the edges of repeats.  Their contexts are cut into pieces of
``STEP`` windows, keyed by the bytes that all of a piece's windows share; pieces with a
key of their own are settled.  The windows of the others, as suffixes, are sorted by key
to the depth of a window: multikey quicksort to a shallow depth, then blind tries
(``suffix_sort``).  Neighbours that agree to the full depth are equal; all but the
earliest are repeats.

A key with more than ``HOT_PIECES`` pieces (a passage in a great many documents) is not
sorted in one task: its windows are compared by 128-bit hashes in grouped minima.

Defined cases: null and empty texts have no bytes; texts shorter than a window lose
nothing; matches never cross documents; a null id sorts first; rows with one id are told
apart by their text, and neither comes before the other; equal rows get equal results;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.anchors import (
    by_document,
    covered,
    earlier_elsewhere,
    found_ranges,
    group_windows,
    keyed,
    order_keys,
    place_of,
    repeated_anchors,
    settled,
    sliding_min,
)
from millrace.llm.spans import BYTE_CODE, FIRST, SECOND, SpanHash, Texts, mix, slices, spread_ranges
from millrace.llm.suffix_sort import sort_suffixes
from millrace.sources.scratch import cut_lineage

LENGTH = 100
GRAM = 32
STEP = 16
HOT_PIECES = 5_000

#: Bytes of pieces that a task sorts at once; keys are not cut.
SORT_BYTES = 2**20

PIECE_FIELDS = "key long, id long, mark int, lo int, m int, piece binary"


def find_anchors(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor rows of a slice (see ``anchors``), in bytes."""
    size = len(texts.data)
    span = SpanHash(BYTE_CODE[texts.data])
    at = np.arange(max(0, size - length + 1))
    text = np.searchsorted(texts.start, at, "right") - 1
    inside = at + length <= texts.start[text + 1]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none.astype(np.uint64)
    grams = np.arange(size - gram + 1)
    hashes = span.of(grams, grams + gram)
    least = place_of(sliding_min(order_keys(hashes), length - gram + 1))
    at, text = at[inside], text[inside]
    anchor = least[at]
    first, count = group_windows(at, text, anchor)
    lo = at[first]
    off = anchor[first] - lo
    context = span.of(lo, lo + count - 1 + length)
    context = mix(context ^ mix((off * 2**32 + count).astype(np.uint64)))
    return hashes[anchor[first]], text[first], lo - texts.start[text[first]], count, off, context


def cut_pieces(rows: DataFrame, unsettled: DataFrame, length: int, step: int) -> DataFrame:
    """The contexts of unsettled rows in pieces of at most ``step`` windows.

    Pieces are cut where the distance from window to anchor is a multiple of ``step``,
    so equal windows are in pieces with one key: gram, distance and common bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                text, lo, m = found_ranges(texts.rows)
                flat = texts.rows.column("found").flatten()
                off = flat.field("off").to_numpy().astype(np.int64)
                gram = flat.field("gram").to_numpy().view(np.uint64)
                # Distances of a row run from ``off`` down to ``off - m + 1``.
                top, low = off // step, (off - m + 1) // step
                block, row = spread_ranges(low, top - low + 1)
                far = np.minimum(off[row], block * step + step - 1)
                near = np.maximum(off[row] - m[row] + 1, block * step)
                anchor = texts.start[text[row]] + lo[row] + off[row]
                begin = anchor - far
                end = anchor - near + length
                # Bytes that every window with a distance in the block has.
                span = SpanHash(BYTE_CODE[texts.data])
                core_begin = anchor - block * step
                core_end = anchor - (block * step + step - 1) + length
                key = mix(gram[row] ^ mix(block.astype(np.uint64))) ^ span.of(core_begin, core_end)
                place, _ = spread_ranges(begin, end - begin)
                border = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
                pieces = pa.Array.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(border), pa.py_buffer(np.ascontiguousarray(texts.data[place]))]
                )
                ids, marks = (texts.rows.column(c).to_numpy()[text[row]] for c in ("id", "mark"))
                columns = [
                    pa.array(key.view(np.int64)), pa.array(ids), pa.array(marks),
                    pa.array((begin - texts.start[text[row]]).astype(np.int32)),
                    pa.array((far - near + 1).astype(np.int32)), pieces,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "mark", "lo", "m", "piece"])

    joined = by_document(rows, unsettled, "gram", "lo", "m", "off")
    return joined.select("id", "mark", "text", "found").mapInArrow(cut, PIECE_FIELDS)


def sort_pieces(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """``(id, mark, lo, m)``: ranges of the pieces' windows that occur earlier among them."""
    piece = next(slices(rows, "piece", limit=2**40))
    m = rows.column("m").to_numpy().astype(np.int64)
    begin, row = spread_ranges(piece.start[:-1], m)
    ids = rows.column("id").to_numpy()[row]
    marks = rows.column("mark").to_numpy()[row]
    lo = rows.column("lo").to_numpy()[row] + begin - piece.start[:-1][row]
    order, group = sort_suffixes(piece.data, begin, length)
    ids, marks, lo = ids[order], marks[order], lo[order]
    inner = np.lexsort((lo, marks, ids, group))
    ids, marks, lo, group = ids[inner], marks[inner], lo[inner], group[inner]
    opens = np.concatenate([[True], group[1:] != group[:-1]])
    repeat = ids > ids[opens][np.cumsum(opens) - 1]
    opens[1:] |= (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
    repeat |= lo > lo[opens][np.cumsum(opens) - 1]
    ids, marks, lo = ids[repeat], marks[repeat], lo[repeat]
    placed = np.lexsort((lo, marks, ids))
    ids, marks, lo = ids[placed], marks[placed], lo[placed]
    first, count = group_windows(lo, ids, marks)
    columns = ids[first], marks[first], lo[first].astype(np.int32), count.astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "mark", "lo", "m"])


def sorted_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """Ranges of windows that occur earlier, by sorting the suffixes of each key."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                yield sort_pieces(rows.combine_chunks().to_batches()[0], length)

        for batch in batches:
            waiting.append(batch)
            if sum(b.column("piece").nbytes for b in waiting) >= SORT_BYTES:
                rows = pa.Table.from_batches(waiting)
                keys = rows.column("key").to_numpy()
                # Keep back the last key, whose pieces may go on in the next batch.
                whole = int(np.searchsorted(keys, keys[-1]))
                yield from flush(rows.slice(0, whole))
                waiting = rows.slice(whole).combine_chunks().to_batches()
        if waiting:
            yield from flush(pa.Table.from_batches(waiting))

    ordered = pieces.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(search, "id long, mark int, lo int, m int")


def hashed_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """The same for keys with very many pieces, by grouped minima over window hashes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece"):
                at, row = spread_ranges(part.start[:-1], part.rows.column("m").to_numpy().astype(np.int64))
                hashes = [SpanHash(BYTE_CODE[part.data], b).of(at, at + length).view(np.int64) for b in (FIRST, SECOND)]
                lo = part.rows.column("lo").to_numpy()[row] + at - part.start[:-1][row]
                columns = (*hashes, *(part.rows.column(c).to_numpy()[row] for c in ("id", "mark")), lo.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "id", "mark", "lo"])

    single = pieces.mapInArrow(explode, "h1 long, h2 long, id long, mark int, lo int").distinct()
    own = single.groupBy("h1", "h2", "id", "mark").agg(F.min("lo").alias("own"))
    single = single.join(own, ["h1", "h2", "id", "mark"]).withColumn("again", F.col("lo") > F.col("own"))
    return earlier_elsewhere(single)


def repeated_windows(rows: DataFrame, length: int, gram: int, step: int, hot: int) -> DataFrame:
    """``(id, mark, lo, m)``: ranges of windows that occur earlier, of ``keyed`` rows."""
    later, unsettled = settled(repeated_anchors(rows, lambda texts: find_anchors(texts, length, gram)))
    pieces = cut_lineage(cut_pieces(rows, unsettled, length, step), "pieces")
    keys = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pieces = cut_lineage(pieces.join(keys.hint("shuffle_hash"), "key"), "shared_pieces")
    few = pieces.where(F.col("n") <= hot).drop("n")
    many = pieces.where(F.col("n") > hot).drop("n")
    return later.union(sorted_repeats(few, length)).union(hashed_repeats(many, length))


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, hot: int = HOT_PIECES
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: every document's bytes without
    those of ``length``-byte strings that start earlier."""
    rows = keyed(documents)
    spans = cut_lineage(repeated_windows(rows, length, gram, step, hot), "repeats")
    lists = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("lo", "m")).alias("found"))
    whole = rows.join(lists.hint("shuffle_hash"), ["id", "mark"], "left")
    whole = whole.select("doc_id", "text", F.coalesce("found", F.array().cast("array<struct<lo:int,m:int>>")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                text, lo, m = found_ranges(texts.rows)
                gone = covered(texts.start[text] + lo, m - 1 + length, len(texts.data))
                opens = gone.copy()
                opens[1:] &= ~gone[:-1]
                borders = texts.start[:-1][np.diff(texts.start) > 0]
                opens[borders] = gone[borders]
                counts = []
                for flags in (gone, opens):
                    total = np.concatenate([[0], np.cumsum(flags)])
                    counts.append(np.diff(total[texts.start]))
                size = np.diff(texts.start)
                border = np.concatenate([[0], np.cumsum(size - counts[0])]).astype(np.int32)
                kept = pa.Array.from_buffers(
                    pa.binary(), len(size), [None, pa.py_buffer(border), pa.py_buffer(texts.data[~gone])]
                )
                yield pa.RecordBatch.from_arrays(
                    [texts.rows.column("doc_id"), pa.array(size), *map(pa.array, counts), kept],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    schema = whole.select("doc_id").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return whole.mapInArrow(cut, schema.add("kept", "binary"))
