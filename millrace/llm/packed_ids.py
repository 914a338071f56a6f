"""Token ids in files of fixed-width bit-packed blocks, with random access.

A shard holds the ids of whole documents: a header, the byte offset of each block, the
document index, and blocks of ``BLOCK`` ids, each id in the fewest bits that hold the
vocabulary.  Blocks are independent, so any range of ids is read by unpacking the
blocks it touches, all at once in numpy.

The files are Parquet folders written by Spark (so they may lie in any store that
Spark writes to): one row per shard with its number of ids, its partition, the ids
before it in that partition, and its image in the binary column ``image``, whose
layout is, little-endian::

    "MRPK" | bits u32 | ids per block u32 | documents u32 | ids u64
    block offsets u64 * (blocks + 1) | doc ids i64 | null flags u8 | ends u64
    blocks

Documents are range-partitioned by id, so shards are in ascending document order; the
first id of a document is the total of earlier partitions (one number each), of earlier
shards of its partition and of earlier documents of its shard.

Defined cases: a null or empty text has the end id only; a null id sorts first; rows
with one id follow each other, ordered by a hash of their text (equal rows in any
order); an empty table gives no shard and no rows; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.spans import (
    LOWER,
    Texts,
    distinct_spans,
    find_words,
    slices,
    span_strings,
    spread_ranges,
    take_ranges,
)
from millrace.sources.scratch import shuffles_freed

MAGIC = b"MRPK"
BLOCK = 4096  # a multiple of 64, so a block is a whole number of 64-bit words
SHARD_IDS = 2**20  # a shard closes with the document that reaches this many ids
SLICE = 2**22

#: Parts whose ids a Python worker remembers, at most; then it starts afresh.
REMEMBERED = 2**20

#: ASCII letters are of kind 1, ASCII punctuation of kind 2, all else of kind 0.
KIND = np.zeros(256, np.uint8)
KIND[list(range(65, 91)) + list(range(97, 123))] = 1
KIND[list(range(33, 48)) + list(range(58, 65)) + list(range(91, 97)) + list(range(123, 127))] = 2
WHOLE = np.isin(np.arange(256), list(b"'<"))


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of ``ids``, ``bits`` each, lowest bits first; whole groups of 64 ids."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 64)
    words = np.zeros((groups, bits), "<u8")
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        words[:, word] |= padded[:, i] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= padded[:, i] >> np.uint64(64 - shift)
    return words.reshape(-1).view(np.uint8)


def unpack(data: np.ndarray, start: int, stop: int, bits: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of packed bytes."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.arange(start, stop, dtype=np.int64) * bits
    words = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    value = words[at >> 3] >> (at & 7).astype(np.uint64)
    return (value & np.uint64((1 << bits) - 1)).astype("<u4")


def shard_image(ids: np.ndarray, doc_ids: np.ndarray, null: np.ndarray, ends: np.ndarray, bits: int) -> bytes:
    parts = [pack(ids[i : i + BLOCK], bits).tobytes() for i in range(0, len(ids), BLOCK)]
    head = MAGIC + np.array([bits, BLOCK, len(ends)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    fixed = len(head) + 8 * (len(parts) + 1) + 17 * len(ends)
    offsets = fixed + np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    index = [offsets.astype("<u8"), doc_ids.astype("<i8"), null.astype(np.uint8), ends.astype("<u8")]
    return b"".join([head, *(x.tobytes() for x in index), *parts])


@dataclass
class Shard:
    """A view of a shard's image."""

    image: np.ndarray
    bits: int
    block: int
    n_ids: int
    offsets: np.ndarray
    doc_ids: np.ndarray
    null: np.ndarray
    ends: np.ndarray

    @classmethod
    def open(cls, image: bytes) -> Shard:
        if image[:4] != MAGIC:
            raise ValueError("not a shard of packed ids")
        bits, block, n_docs = np.frombuffer(image, "<u4", 3, 4).tolist()
        n_ids = int(np.frombuffer(image, "<u8", 1, 16)[0])
        at, columns = 24, []
        for kind, count in (("<u8", -(-n_ids // block) + 1), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs)):
            columns.append(np.frombuffer(image, kind, count, at))
            at += count * np.dtype(kind).itemsize
        offsets, doc_ids, null, ends = columns
        return cls(np.frombuffer(image, np.uint8), bits, block, n_ids, offsets.astype(np.int64), doc_ids, null > 0, ends.astype(np.int64))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard, from the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self.image[self.offsets[first] : self.offsets[last + 1]]
        return unpack(data, start - first * self.block, stop - first * self.block, self.bits)

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document."""
        return self.read(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class WordIds:
    """Ids of words by a tokenizer for which white space separates tokens.

    A part's ids do not depend on its neighbours, so a worker tokenizes a part once
    and remembers its ids by two hashes, up to ``REMEMBERED`` parts (see ``find_parts``).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        probe = [self.ids_of(x) for x in ("A b", "a", "b", "a,b!! c", ",", "!!", "c")]
        if probe[0] != probe[1] + probe[2]:
            raise ValueError("white space and case must not matter to this tokenizer")
        #: Whether letters and punctuation are always separate tokens.
        self.parted = probe[3] == probe[1] + probe[4] + probe[2] + probe[5] + probe[6]
        special = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.break_ = special[0].content if special else None
        self.break_id = self.tokenizer.token_to_id(self.break_) if special else None
        self.forget()

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # quick hashes of the parts known, ascending
        self.second = np.zeros(0, np.uint64)
        self.row = np.zeros(0, np.int64)  # where their ids are
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def tokenize(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all names and how many each has.

        Names are joined by a special token, which parts a text before all else, and
        encoded as one text; names that may hold special tokens go one by one.
        """
        odd = [i for i, name in enumerate(names) if "<" in name] if self.break_ else range(len(names))
        found = dict(zip(odd, self.tokenizer.encode_batch_fast([names[i] for i in odd], add_special_tokens=False)))
        plain = [name for i, name in enumerate(names) if i not in found]
        sizes = np.zeros(len(names), np.int64)
        ids = np.zeros(0, np.uint32)
        if plain:
            joined = np.array(self.ids_of(self.break_.join(plain)), np.uint32)
            breaks = joined == self.break_id
            where = np.concatenate([[-1], np.flatnonzero(breaks), [len(joined)]])
            is_plain = np.ones(len(names), bool)
            is_plain[list(found)] = False
            sizes[is_plain] = np.diff(where) - 1
            ids = joined[~breaks]
        if not found:
            return ids, sizes
        for i, encoded in found.items():
            sizes[i] = len(encoded.ids)
        first = np.concatenate([[0], np.cumsum(sizes)])
        whole = np.empty(first[-1], np.uint32)
        from_odd = np.zeros(len(whole), bool)
        for i, encoded in found.items():
            whole[first[i] : first[i + 1]] = encoded.ids
            from_odd[first[i] : first[i + 1]] = True
        whole[~from_odd] = ids
        return whole, sizes

    def rows(self, one: np.ndarray, two: np.ndarray, names: Callable[[np.ndarray], list[str]]) -> np.ndarray:
        """The row of the ids of each part, given by its hashes; ``names`` gives the strings
        of those that are not remembered and hence are tokenized.

        Of parts with one first hash, the first to come is remembered.
        """
        at, same = self.find(one)
        new = np.flatnonzero(~(same & (self.second_at(at) == two)))
        if len(self.keys) + len(new) > REMEMBERED:
            self.forget()
            at, same, new = np.zeros(len(one), np.int64), np.zeros(len(one), bool), np.arange(len(one))
        row = np.where(same, self.row[np.minimum(at, len(self.row) - 1)] if len(self.row) else -1, -1)
        if len(new):
            ids, sizes = self.tokenize(names(new))
            row[new] = len(self.first) - 1 + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            fresh = new[~same[new]]
            fresh = fresh[np.unique(one[fresh], return_index=True)[1]]
            self.row = np.insert(self.row, at[fresh], row[fresh])
            self.second = np.insert(self.second, at[fresh], two[fresh])
            self.keys = np.insert(self.keys, at[fresh], one[fresh])
        return row

    def find(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each first hash, and whether it is there."""
        at = np.searchsorted(self.keys, one)
        if not len(self.keys):
            return at, np.zeros(len(one), bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == one

    def second_at(self, at: np.ndarray) -> np.ndarray:
        if not len(self.second):
            return np.zeros(len(at), np.uint64)
        return self.second[np.minimum(at, len(self.second) - 1)]

    def encode(self, texts: Texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice with the end id, and how many each text has."""
        data, start, stop = find_parts(texts, self.parted)
        one, two, where, back = distinct_spans(data, start, stop)
        row = self.rows(one, two, lambda new: span_strings(data, start[where[new]], stop[where[new]]).to_pylist())
        # After the parts of each text comes the end id, the last row of the table.
        ends = np.searchsorted(start, texts.start[1:])
        sequence = np.insert(row[back], ends, len(self.first) - 1)
        ids, first = np.append(self.ids, np.uint32(end)), np.append(self.first, len(self.ids) + 1)
        flat, count = take_ranges(ids, first, sequence)
        total = np.concatenate([[0], np.cumsum(count)])
        return flat, np.diff(total[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])])


def find_parts(texts: Texts, parted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and spans that can be tokenized one by one: words in ASCII lower case, cut
    between ASCII letters and punctuation.  A word with an apostrophe (contractions) or
    ``<`` (special tokens) stays as it is."""
    words = find_words(texts)
    total = np.concatenate([[0], np.cumsum(WHOLE[texts.data])])
    whole = total[words.end] > total[words.start]
    data = LOWER[texts.data]
    kept, _ = spread_ranges(words.start[whole], (words.end - words.start)[whole])
    data[kept] = texts.data[kept]
    if not parted:
        return data, words.start, words.end
    kind = KIND[data]
    kind[kept] = 0
    cut = np.flatnonzero((kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    start = np.sort(np.concatenate([words.start, cut]))
    stop = np.sort(np.concatenate([words.end, cut]))
    return data, start, stop


@cache
def word_ids(path: str) -> WordIds:
    """The tokenizer at ``path``, loaded once per worker."""
    return WordIds(path)


SHARD_SCHEMA = "part int, before long, n_docs long, n_ids long, image binary"


def pack_documents(documents: DataFrame, path: str, end: int) -> DataFrame:
    """Shards of the ids of all texts, in ascending order of ``doc_id``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        bits = bits_for(encoder.vocabulary)
        part, before = TaskContext.get().partitionId(), 0
        waiting: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal before
            ids, sizes, docs, null = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            image = shard_image(ids, docs, null, np.cumsum(sizes), bits)
            values = (part, before, len(sizes), len(ids), image)
            before += len(ids)
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, values))], kinds)

        kinds = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])
        for batch in batches:
            for texts in slices(batch, limit=SLICE):
                ids, sizes = encoder.encode(texts, end)
                column = texts.rows.column("doc_id")
                null = column.is_null().to_numpy(zero_copy_only=False)
                waiting.append((ids, sizes, column.fill_null(0).to_numpy(), null))
                if sum(len(x[0]) for x in waiting) >= SHARD_IDS:
                    yield close()
        if waiting:
            yield close()

    ordered = (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return ordered.mapInArrow(shards, SHARD_SCHEMA)


def write_packed(documents: DataFrame, folder: str, path: str, end: int) -> None:
    """Encode ``documents`` and write their shards to ``folder``."""
    with shuffles_freed(documents.sparkSession):
        pack_documents(documents, path, end).write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def part_offsets(shards: DataFrame) -> DataFrame:
    """``(part, offset)``: the ids before each partition of the files.

    One row per partition: the only table that meets in one task.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    return parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset"))


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``(start, ids)``: the ids at the places ``start`` to ``stop`` of the whole sequence,
    a row per shard that has some, as little-endian unsigned 32-bit integers.

    Places of shards are read first; only images of shards within the range are, and of
    these only the blocks within it are unpacked.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    places = shards.select("part", "before", "n_ids").join(F.broadcast(part_offsets(shards)), "part")
    first = F.col("offset") + F.col("before")
    wanted = places.where((first < stop) & (first + F.col("n_ids") > start)).select("part", "before", first.alias("first"))
    found = wanted.agg(F.sort_array(F.collect_set("part"))).first()[0]
    # A shard of the range is one row of metadata; the parts prune files by their statistics.
    images = shards.where(F.col("part").isin(found)).join(F.broadcast(wanted), ["part", "before"])

    def unpack_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, image in zip(batch.column("first").to_pylist(), batch.column("image")):
                ids = Shard.open(image.as_py()).read(max(start - first, 0), stop - first)
                columns = [pa.array([max(start, first)], pa.int64()), pa.array([ids.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["start", "ids"])

    return images.select("first", "image").mapInArrow(unpack_ranges, "start long, ids binary")


def read_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: ``(doc_id, start, n_tokens, ids)``, ids as
    little-endian unsigned 32-bit integers."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    parts = part_offsets(shards)

    def unpack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(c) for c in ("part", "before", "image"))):
                shard = Shard.open(image.as_py())
                ids = shard.read(0, shard.n_ids)
                starts = np.concatenate([[0], shard.ends[:-1]]).astype(np.int64)
                border = np.append(starts, shard.n_ids) * 4
                packed = pa.Array.from_buffers(
                    pa.binary(), len(starts), [None, pa.py_buffer(border.astype(np.int32)), pa.py_buffer(ids)]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), part.as_py(), np.int32)),
                        pa.array(shard.doc_ids, mask=shard.null),
                        pa.array(starts + before.as_py()),
                        pa.array(shard.ends - starts),
                        packed,
                    ],
                    ["part", "doc_id", "within", "n_tokens", "ids"],
                )

    rows = shards.select("part", "before", "image").mapInArrow(
        unpack_shards, "part int, doc_id long, within long, n_tokens long, ids binary"
    )
    placed = rows.join(F.broadcast(parts), "part")
    return placed.select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids")

