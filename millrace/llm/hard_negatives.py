"""Hard-negative mining over rotated one-bit codes with residual intervals.

Vectors are turned into whole numbers, so scores are exact.  Every vector is also rotated
by one random rotation and stored as planes of one bit per dimension: with one plane the
signs, with more the sign, the half, the quarter and so on of its range.  The planes add
up to a code vector; stored with it are its alignment (what part of the vector lies along
it) and the length of the residual, which is perpendicular to it.

The inner product of two code vectors is a weighted sum of popcounts.  From it follow an
estimate of the score and, by the Cauchy-Schwarz inequality on both residuals, an interval
that holds the score for certain.  A row is scored in whole numbers only if its interval
reaches into the wanted range and up to the worst of the best rows found so far, so the
answer is that of comparing everything.

The anchors are a stated part of the rows.  They are taken in blocks of about
``BLOCK_ANCHORS``, the only data that is broadcast; all rows stay where they are and are
read once per pass and block: first for the positives, then for the negatives.  A task
gives out its best rows per anchor, and Spark ranks those of all tasks, so neither a
frequent label nor a vector that a third of all rows have makes a large group.

Defined cases: rows with a null label or vector, or with a null or non-finite component,
take no part; a shorter vector is filled up with zeros; components are held within
``limit``, beyond which a score would not fit a long; equal scores rank by id, null first;
rows that share an id are rows of their own, and an anchor is never its own positive;
repeated anchors have repeated results; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.scratch import cut_lineage, free_table, new_folder, shuffles_freed

SCALE = 256
PLANES = 4
ANCHOR_PLANES = 6
BLOCK_ANCHORS = 16_384
SEED = 20_011

#: Anchors and rows that are compared at once.
TILE_ANCHORS = 512
TILE_ROWS = 1024
PAIRS_AT_ONCE = 2**17

NOTHING = -(2**63)
NO_ID = -(2**63)

CODES = (
    "number long, id long, label long, anchor boolean, whole binary, "
    "planes binary, fine binary, align double, rest double, fine_align double, fine_rest double"
)


def limit(width: int) -> int:
    """The largest component with which every inner product fits a long."""
    return min(2**31 - 1, isqrt((2**63 - 1) // width))


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same each time."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))[0]


def code_planes(rotated: np.ndarray, planes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes ``(row, plane, word)`` of rotated vectors, alignment and residual.

    Plane ``s`` weighs ``2**s``; a bit stands for 1 or -1.
    """
    n, width = rotated.shape
    top = np.abs(rotated).max(axis=1, initial=0)
    step = np.where(top > 0, top, 1) / 2 ** (planes - 1)
    level = np.clip(np.floor(rotated / step[:, None]) + 2 ** (planes - 1), 0, 2**planes - 1).astype(np.int64)
    code = 2.0 * level - (2**planes - 1)
    align = np.einsum("ij,ij->i", rotated, code) / np.maximum(np.einsum("ij,ij->i", code, code), 1)
    rest = np.linalg.norm(rotated - align[:, None] * code, axis=1)
    bits = np.zeros((n, planes, -(-width // 64) * 64), np.uint8)
    for s in range(planes):
        bits[:, s, :width] = level >> s & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), align, rest


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    data = np.ascontiguousarray(rows).reshape(len(rows), -1)
    size = data.shape[1] * data.itemsize
    ends = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(data)])


def matrix(column: pa.ChunkedArray | pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """The inverse of ``binaries``."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


@dataclass
class Codes:
    """Vectors of a batch: whole numbers, planes and what the intervals need."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    whole: np.ndarray
    planes: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    length: np.ndarray
    code_length: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table | pa.RecordBatch, width: int, fine: bool = False) -> Codes:
        words, before = -(-width // 64), "fine_" if fine else ""
        count = ANCHOR_PLANES if fine else PLANES
        planes = matrix(rows.column("fine" if fine else "planes"), np.uint64, (count, words))
        whole = matrix(rows.column("whole"), np.int32, (width,))
        align, rest = (rows.column(before + c).to_numpy() for c in ("align", "rest"))
        own = [rows.column(c).to_numpy() for c in ("number", "id", "label")]
        length = np.linalg.norm(whole.astype(np.float64), axis=1)
        # |vector|^2 = align^2 |code|^2 + rest^2; the code itself gives its length without loss.
        bits = np.unpackbits(planes.view(np.uint8), axis=2, bitorder="little")[:, :, :width].astype(np.int64)
        code = sum((2 * bits[:, s] - 1) << s for s in range(count))
        return cls(*own, whole, planes, align, rest, length, np.linalg.norm(code, axis=1))

    def take(self, which: np.ndarray | slice) -> Codes:
        return Codes(**{name: value[which] for name, value in vars(self).items()})

    def __len__(self) -> int:
        return len(self.number)


def encode(vectors: DataFrame, anchor: Column, scale: int) -> tuple[DataFrame, int]:
    """The written table of ``CODES``, and the number of dimensions."""
    usable = F.forall("vector", lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & usable).select(
        F.monotonically_increasing_id().alias("number"),
        F.coalesce("id", F.lit(NO_ID)).alias("id"),
        "label",
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        "vector",
    )
    width = max(rows.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    turn, most = rotation(width), limit(width)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("vector")
            size = pc.list_value_length(vector).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.zeros((batch.num_rows, width))
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            with np.errstate(over="ignore"):
                found = np.floor(scale * vector.flatten().to_numpy(zero_copy_only=False))
            whole[row, place] = np.clip(found, -most, most)
            rotated = whole @ turn
            planes, align, rest = code_planes(rotated, PLANES)
            fine, fine_align, fine_rest = code_planes(rotated, ANCHOR_PLANES)
            is_anchor = batch.column("anchor")
            # Only anchors need the finer planes.
            fine = pc.if_else(is_anchor, binaries(fine), pa.scalar(None, pa.binary()))
            columns = [
                *(batch.column(c) for c in ("number", "id", "label")), is_anchor, binaries(whole.astype(np.int32)),
                binaries(planes), fine, *map(pa.array, (align, rest, fine_align, fine_rest)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in CODES.split(", ")])

    return cut_lineage(rows.mapInArrow(measure, CODES), "codes"), width


def intervals(anchors: Codes, rows: Codes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Certain lower and upper bounds of all scores of ``anchors`` with ``rows``."""
    dots = np.zeros((len(anchors), len(rows)), np.int64)
    for t in range(anchors.planes.shape[1]):
        for s in range(rows.planes.shape[1]):
            apart = np.zeros(dots.shape, np.int32)
            for word in range(rows.planes.shape[2]):
                apart += np.bitwise_count(anchors.planes[:, t, word][:, None] ^ rows.planes[:, s, word])
            dots += (width - 2 * apart.astype(np.int64)) << (s + t)
    dots = dots.astype(np.float64)
    size = np.maximum(rows.code_length, 1)
    # The anchor with the row's code: along the anchor's code, and at most its residual's part.
    middle = anchors.align[:, None] * dots
    other = rows.code_length**2 - (dots / np.maximum(anchors.code_length, 1)[:, None]) ** 2
    slack = anchors.rest[:, None] * np.sqrt(np.maximum(other, 0))
    # The anchor with the row's residual: only what of the anchor is not along the row's code.
    along = np.maximum(np.abs(middle) - slack, 0) / size
    across = np.sqrt(np.maximum(anchors.length[:, None] ** 2 - along**2, 0))
    # Rounding of doubles is far below one part in 10**9 of the two lengths.
    error = rows.align * slack + rows.rest * across + 1e-9 * (anchors.length[:, None] * rows.length + 1)
    estimate = rows.align * middle
    return estimate - error, estimate + error


def exact(anchors: Codes, rows: Codes, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer scores of pairs."""
    found = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        found[part] = np.einsum("ij,ij->i", anchors.whole[a[part]], rows.whole[r[part]], dtype=np.int64)
    return found


class Best:
    """The best ``k`` rows of each slot: highest score, then least id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: A lower score cannot enter the slot any more.
        self.worst = np.full(slots, NOTHING, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        use = score >= self.worst[slot]
        slot = np.concatenate([self.slot, slot[use]])
        score, row_id = np.concatenate([self.score, score[use]]), np.concatenate([self.id, row_id[use]])
        order = np.lexsort((row_id, -score, slot))
        slot, score, row_id = slot[order], score[order], row_id[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], row_id[keep]
        last = rank[keep] == self.k - 1
        self.worst[self.slot[last]] = self.score[last]


def tiles(anchors: Codes, batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, Codes, Codes]]:
    """Parts of the anchors, from which place, with parts of the rows."""
    for batch in batches:
        rows = Codes.of(batch, width)
        for r in range(0, len(rows), TILE_ROWS):
            part = rows.take(slice(r, r + TILE_ROWS))
            for a in range(0, len(anchors), TILE_ANCHORS):
                yield a, anchors.take(slice(a, a + TILE_ANCHORS)), part


def best_positives(anchors: Codes, batches: Iterator[pa.RecordBatch], width: int, k: int) -> Best:
    """Per anchor the best other rows of its label."""
    best = Best(len(anchors), k)
    for first, some, rows in tiles(anchors, batches, width):
        for label in np.intersect1d(some.label, rows.label):
            mine, theirs = np.flatnonzero(some.label == label), np.flatnonzero(rows.label == label)
            left, right = some.take(mine), rows.take(theirs)
            _, upper = intervals(left, right, width)
            near = (upper >= best.worst[first + mine][:, None]) & (left.number[:, None] != right.number)
            a, r = np.nonzero(near)
            best.add(first + mine[a], exact(left, right, a, r), right.id[r])
    return best


def best_negatives(
    anchors: Codes, positive: np.ndarray, batches: Iterator[pa.RecordBatch], width: int, k: int, low: int, high: int
) -> Best:
    """Per anchor and positive the best rows of other labels within the range.

    ``positive`` has the scores ``(anchor, place)`` of the positives, ``NOTHING`` for none.
    """
    places = positive.shape[1]
    best = Best(len(anchors) * places, k)
    # Python's integers: a bound times a percentage may not fit a long.
    floor = np.array([[-(-low * int(p) // 100) for p in ps] for ps in positive], object).reshape(positive.shape)
    ceiling = np.array([[high * int(p) // 100 for p in ps] for ps in positive], object).reshape(positive.shape)
    open_ = (positive != NOTHING) & (floor <= ceiling)
    floor, ceiling = (np.where(open_, x, 0).astype(np.int64) for x in (floor, ceiling))
    for first, some, rows in tiles(anchors, batches, width):
        own = slice(first, first + len(some))
        lower, upper = intervals(some, rows, width)
        slots = (np.arange(first, first + len(some))[:, None] * places) + np.arange(places)
        least = np.maximum(floor[own], best.worst[slots])
        other = some.label[:, None] != rows.label
        wanted = np.zeros(other.shape, bool)
        for j in range(places):
            fits = (upper >= least[:, j, None]) & (lower <= ceiling[own][:, j, None])
            wanted |= fits & open_[own][:, j, None]
        a, r = np.nonzero(wanted & other)
        score, row_id = exact(some, rows, a, r), rows.id[r]
        for j in range(places):
            use = open_[own][a, j] & (score >= floor[own][a, j]) & (score <= ceiling[own][a, j])
            best.add(slots[a[use], j], score[use], row_id[use])
    return best


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each group, with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_block(
    codes: DataFrame, block: pa.Table, width: int, positives: int, negatives: int, low: int, high: int
) -> DataFrame:
    """The result for the anchors of one block."""
    spark = codes.sparkSession
    anchors = Codes.of(block, width, fine=True)
    sent = spark.sparkContext.broadcast(anchors)

    def give_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = best_positives(sent.value, batches, width, positives)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.slot, best.score, best.id)], ["slot", "score", "id"])

    found = codes.mapInArrow(give_positives, "slot long, score long, id long")
    # At most ``positives`` rows for each anchor of the block.
    rows = ranked(found, ["slot"], positives).toArrow()
    slot, place = rows.column("slot").to_numpy(), rows.column("rank").to_numpy() - 1
    score = np.full((len(anchors), positives), NOTHING, np.int64)
    ids = np.full((len(anchors), positives), NO_ID, np.int64)
    score[slot, place] = rows.column("score").to_numpy()
    ids[slot, place] = rows.column("id").to_numpy()
    sent_positives = spark.sparkContext.broadcast((score, ids))
    names = ["slot", "anchor_id", "positive_id", "positive_score", "id", "score"]

    def give_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (score, ids) = sent.value, sent_positives.value
        best = best_negatives(anchors, score, batches, width, negatives, low, high)
        owner = np.divmod(best.slot, positives)
        columns = [best.slot, anchors.id[owner[0]], ids[owner], score[owner], best.id, best.score]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    found = codes.mapInArrow(give_negatives, ", ".join(f"{name} long" for name in names))
    best = ranked(found, ["slot"], negatives)
    shown = {name: F.when(F.col(name) != NO_ID, F.col(name)) for name in ("anchor_id", "positive_id", "id")}
    return best.select(
        shown["anchor_id"].alias("anchor_id"),
        shown["positive_id"].alias("positive_id"),
        "rank",
        shown["id"].alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def mine_negatives(
    rows: DataFrame,
    anchor: Column,
    vector: str = "embedding",
    row_id: str = "vec_id",
    label: str | Column = "label",
    scale: int = SCALE,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows where ``anchor`` holds.  Each one's ``positives`` best other rows
    of the same label are its positives, and for each of these the ``negatives`` best rows
    of other labels whose score is ``low`` to ``high`` percent of the positive's are given.
    """
    label = F.col(label) if isinstance(label, str) else label
    vectors = rows.select(
        F.col(row_id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
        anchor.alias("anchor"),
    )
    codes, width = encode(vectors, F.col("anchor"), scale)
    spark = rows.sparkSession
    marked = codes.where("anchor")
    blocks = max(1, -(-marked.count() // block_anchors))
    folder = new_folder(spark, "negatives")
    for i in range(blocks):
        block = marked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == i).toArrow()
        found = mine_block(codes, block, width, positives, negatives, low, high)
        with shuffles_freed(spark):
            found.write.parquet(f"{folder}/block={i}")
    free_table(codes)
    return spark.read.schema(found.schema).parquet(folder).select(*found.columns)
