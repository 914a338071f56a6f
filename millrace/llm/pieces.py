"""SentencePiece encoding and decoding through a table of distinct chunks.

If no piece of the model has the white-space marker behind another character, merges
cannot cross the border between a character and a following marker.  A text then is a
sequence of chunks (markers, then other characters) that are segmented independently,
and the ids of a text are the ids of its chunks, joined by position.

1. Spark counts the distinct chunks of all texts (partial counts per slice and task
   before the shuffle).
2. Chunks seen more than once, most frequent first, form the table, each segmented
   once; a histogram of the counts gives the lowest count with which the table stays
   within ``TABLE_ROWS``, so it can be sent to every task whatever the corpus.
3. Texts look their chunks up by position.  A chunk outside the table is segmented
   where it occurs, once per slice of text.

Decoding goes the same way back: bytes of the pieces by position.

Defined cases: a null or empty text has begin and end ids only and decodes to the
empty text; rows are encoded one by one, so repeated rows agree and a repeated or null
id does no harm; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import BYTE_CODE, QuickHash, SpanHash, Texts, distinct_spans, slices, span_strings, take_ranges
from millrace.sources.scratch import cut_lineage, free_table

MARKER = "▁"

#: Rows of the chunk table, at most: a bound for what is sent to every task.
TABLE_ROWS = 2**18

SLICE = 2**21

# Counts up to EXACT have a bin each in the histogram, larger ones a bin per power of two.
EXACT = 4096


@dataclass(frozen=True)
class Pieces:
    """A loaded model: its library object and, per id, the bytes that it stands for."""

    model: sentencepiece.SentencePieceProcessor
    surface: np.ndarray
    first: np.ndarray

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks given with their leading space, which the library adds itself."""
        ids = self.model.encode([c[1:] for c in chunks], num_threads=1)
        alone = [self.model.piece_to_id(MARKER)]
        return [alone if c == " " else found for c, found in zip(chunks, ids)]


@cache
def load(path: str) -> Pieces:
    """The model at ``path``, loaded once per worker."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    if any(MARKER in name.lstrip(MARKER) for name in names):
        raise ValueError("pieces cross white-space markers: chunks are not independent")
    if not any(model.is_byte(i) for i in range(size)):
        raise ValueError("a model with byte fallback is needed")
    surface = [
        b"" if model.is_control(i)
        else bytes([int(name[3:5], 16)]) if model.is_byte(i)
        else name.replace(MARKER, " ").encode()
        for i, name in enumerate(names)
    ]
    first = np.concatenate([[0], np.cumsum([len(x) for x in surface])])
    return Pieces(model, np.frombuffer(b"".join(surface), np.uint8), first)


@dataclass
class Chunks:
    """Chunk spans of a slice; ``first[i]:first[i + 1]`` are the chunks of text i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def distinct(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each distinct chunk, one place of it, and each chunk's number."""
        return distinct_spans(texts.data, self.start, self.end)


def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts with a leading space, unless empty, and markers written as spaces."""
    text = pc.fill_null(batch.column("text"), "")
    text = pc.replace_substring(text, MARKER, " ")
    text = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(" ", text, ""))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])


def find_chunks(texts: Texts) -> Chunks:
    """A chunk opens at each space that does not follow a space of the same text."""
    space = texts.data == 0x20
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[texts.start[:-1][np.diff(texts.start) > 0]] = True
    start = np.flatnonzero(opens)
    return Chunks(start, np.append(start[1:], len(texts.data)), np.searchsorted(start, texts.start))


def count_chunks(documents: DataFrame) -> DataFrame:
    """``(chunk, n)``: all distinct chunks and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(marked(batch), limit=SLICE):
                chunks = find_chunks(texts)
                _, _, where, back = chunks.distinct(texts)
                names = span_strings(texts.data, chunks.start[where], chunks.end[where])
                n = np.bincount(back, minlength=len(where))
                yield pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64())], ["chunk", "n"])

    parts = documents.select("doc_id", "text").mapInArrow(count, "chunk string, n long")
    return parts.groupBy("chunk").agg(F.sum("n").alias("n"))


def count_floor(counts: DataFrame, rows: int) -> int:
    """The lowest count with which at most ``rows`` chunks are as frequent or more."""
    n = F.col("n")
    step = F.when(n < EXACT, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))
    bins = counts.groupBy(step.alias("low")).count().orderBy(F.desc("low")).collect()
    floor, total = None, 0
    for low, here in bins:
        total += here
        if total > rows:
            break
        floor = low
    return floor if floor is not None else 2**62


@dataclass
class ChunkTable:
    """Segmented chunks, sorted by hash."""

    one: np.ndarray
    two: np.ndarray
    ids: np.ndarray
    first: np.ndarray

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Row of each chunk, -1 for those that are not here."""
        if not len(self.one):
            return np.full(len(one), -1)
        at = np.minimum(np.searchsorted(self.one, one), len(self.one) - 1)
        return np.where((self.one[at] == one) & (self.two[at] == two), at, -1)


def chunk_table(documents: DataFrame, path: str, rows: int = TABLE_ROWS) -> ChunkTable:
    """The table of the most frequent chunks, each segmented once, by Spark tasks."""
    counts = cut_lineage(count_chunks(documents).where("n > 1"), "chunks")
    frequent = counts.where(F.col("n") >= count_floor(counts, rows)).select("chunk")

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for texts in slices(batch, "chunk"):
                start, end = texts.start[:-1], texts.start[1:]
                ids = pieces.segment(texts.rows.column("chunk").to_pylist())
                found = QuickHash.of(texts.data, start, end), SpanHash(BYTE_CODE[texts.data]).of(start, end)
                hashes = [pa.array(h.view(np.int64)) for h in found]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, pa.array(ids, pa.list_(pa.int32()))], ["one", "two", "ids"]
                )

    found = frequent.mapInArrow(segment, "one long, two long, ids array<int>").toArrow()
    free_table(counts)
    one, two = (found.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))
    order = np.argsort(one)
    ids = found.column("ids").combine_chunks()
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat, sizes = take_ranges(ids.flatten().to_numpy().astype(np.uint32), first, order)
    return ChunkTable(one[order], two[order], flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def encode_slice(texts: Texts, pieces: Pieces, table: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, without begin and end, and how many each text has."""
    chunks = find_chunks(texts)
    one, two, where, back = chunks.distinct(texts)
    row = table.find(one, two)
    rest = np.flatnonzero(row < 0)
    names = span_strings(texts.data, chunks.start[where[rest]], chunks.end[where[rest]])
    found = pieces.segment(names.to_pylist())
    sizes = np.concatenate([np.diff(table.first), [len(x) for x in found]]).astype(np.int64)
    ids = np.concatenate([table.ids, np.array([i for x in found for i in x], np.uint32)])
    row[rest] = len(table.one) + np.arange(len(rest))
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat, count = take_ranges(ids, first, row[back])
    total = np.concatenate([[0], np.cumsum(count)])
    return flat, np.diff(total[chunks.first])


def decode_bytes(ids: np.ndarray, count: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with ``count`` ids each, without the leading space, and sizes."""
    data, sizes = take_ranges(pieces.surface, pieces.first, ids.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(sizes)])
    border = total[np.concatenate([[0], np.cumsum(count)])]
    size = np.diff(border)
    filled = size > 0
    keep = np.ones(len(data), bool)
    keep[border[:-1][filled]] = data[border[:-1][filled]] != 0x20
    dropped = np.zeros(len(size), np.int64)
    dropped[filled] = ~keep[border[:-1][filled]]
    return data[keep], size - dropped


def encode_documents(documents: DataFrame, path: str, table: ChunkTable | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``: little-endian 32-bit ids with begin and end, and the
    text that they decode to."""
    table = table if table is not None else chunk_table(documents, path)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, here = load(path), shared.value
        begin, end = pieces.model.bos_id(), pieces.model.eos_id()
        for batch in batches:
            for texts in slices(marked(batch), limit=SLICE):
                ids, count = encode_slice(texts, pieces, here)
                data, size = decode_bytes(ids, count, pieces)
                border = np.concatenate([[0], np.cumsum(size)])
                decoded = span_strings(data, border[:-1], border[1:])
                first = np.concatenate([[0], np.cumsum(count + 2)])
                whole = np.empty(first[-1], "<u4")
                inner = np.ones(len(whole), bool)
                whole[first[:-1]], whole[first[1:] - 1] = begin, end
                inner[first[:-1]] = inner[first[1:] - 1] = False
                whole[inner] = ids
                packed = pa.Array.from_buffers(
                    pa.binary(), len(count), [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(whole)]
                )
                columns = [texts.rows.column("doc_id"), packed, decoded]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    source = documents.select("doc_id", "text")
    schema = source.select("doc_id").schema.add("ids", "binary").add("decoded", "string")
    return source.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, decoded)`` of ``(doc_id, ids)`` rows as ``encode_documents`` gives them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = part.data.view("<u4") if part.data.flags.c_contiguous else part.data.copy().view("<u4")
                data, size = decode_bytes(ids, np.diff(part.start) // 4, pieces)
                border = np.concatenate([[0], np.cumsum(size)])
                text = span_strings(data, border[:-1], border[1:])
                yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), text], ["doc_id", "decoded"])

    source = encoded.select("doc_id", "ids")
    schema = source.select("doc_id").schema.add("decoded", "string")
    return source.mapInArrow(decode, schema)
