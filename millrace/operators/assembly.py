"""Training-set assembly: order, split, group, batch, mask, pad and pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokens as T
from millrace.operators.positions import (
    global_position,
    hash_levels,
    id_levels,
    running_total,
    seeded_hash,
)
from millrace.sources.scratch import cut_lineage


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``shuffle_hash`` and the ``position`` in a reproducible random order."""
    hashed = df.withColumn("shuffle_hash", seeded_hash(key, seed))
    return global_position(
        hashed, hash_levels("shuffle_hash"), [F.col("shuffle_hash"), F.col(key)]
    )


def jitter(key: str, buffer: int, seed: int) -> Column:
    """How many places, fewer than ``buffer``, a row moves back."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long") % buffer


def buffer_shuffle(df: DataFrame, key: str, buffer: int = 500, seed: int = 42) -> DataFrame:
    """Shuffle in key order with places moved by less than ``buffer``."""
    placed = global_position(df, id_levels(key), [F.col(key)], name="_source")
    placed = cut_lineage(placed, "source-order")
    moved = placed.withColumn("_moved", F.col("_source") + jitter(key, buffer, seed))
    return global_position(
        moved, id_levels("_moved"), [F.col("_moved"), F.col("_source")]
    ).drop("_source", "_moved")


def train_val_split(df: DataFrame, fraction: float = 0.9) -> DataFrame:
    """Mark the first ``int(n * fraction)`` positions as train, the rest as val.

    Counting runs a job: pass a written table.
    """
    cut = int(df.count() * fraction)
    return df.withColumn("split", F.when(F.col("position") <= cut, "train").otherwise("val"))


def length_groups(train: DataFrame, key: str, batch_size: int = 6) -> DataFrame:
    """Sort shuffled rows by length, stably, and cut runs of ``batch_size``.

    One length may hold a third of all rows, so buckets are cut by the shuffle
    hash below the length.
    """
    placed = global_position(
        train,
        levels=[F.col("length"), F.substring("shuffle_hash", 1, 4)],
        order=[F.col("shuffle_hash"), F.col(key)],
        name="length_rank",
    )
    return placed.withColumn("group_id", F.floor((F.col("length_rank") - 1) / batch_size))


def shuffle_batches(
    groups: DataFrame, batch_size: int = 6, seed: int = 42, align: bool = False
) -> DataFrame:
    """Shuffle the groups, flatten them, and cut batches from the result.

    A short last group shifts every later batch; ``align`` puts it at the end.
    """
    group_hash = seeded_hash("group_id", seed)
    levels = hash_levels(group_hash)
    if align:
        rows = groups.count()
        short = (F.col("group_id") == rows // batch_size).cast("int") if rows % batch_size else F.lit(0)
        levels = [short, *levels]
    hashed = groups.withColumn("_hash", group_hash)
    placed = global_position(
        hashed, levels, [F.col("_hash"), F.col("group_id"), F.col("length_rank")],
        name="train_position",
    )
    return cut_batches(placed.drop("_hash"), batch_size, "train_position")


def cut_batches(df: DataFrame, batch_size: int = 6, position: str = "position") -> DataFrame:
    """Add ``batch_id`` and ``pos_in_batch`` to rows with positions 1..N."""
    before = F.col(position) - 1
    return df.withColumns(
        {
            "batch_id": F.floor(before / batch_size),
            "pos_in_batch": F.pmod(before, F.lit(batch_size)).cast("int"),
        }
    )


def resume_from(df: DataFrame, n_seen: int, position: str = "position") -> DataFrame:
    """Skip the first ``n_seen`` examples of an ordered set."""
    return df.where(F.col(position) > n_seen)


#: Examples of one folder of an ordered set.
BLOCK_ROWS = 1_000_000


def write_ordered(df: DataFrame, path: str, position: str = "position", block_rows: int = BLOCK_ROWS) -> None:
    """Write rows with positions 1..N so that a resumed run reads only what is left.

    A folder has the examples of one range of positions, which its name tells, so a
    resume lists folders and opens none of those that it has seen.
    """
    block = F.floor((F.col(position) - 1) / block_rows).alias("block")
    dealt = df.select("*", block).repartitionByRange("block", position).sortWithinPartitions("block", position)
    dealt.write.mode("overwrite").partitionBy("block").parquet(path)


def read_ordered(
    spark: SparkSession, path: str, n_seen: int = 0, position: str = "position", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The examples after the first ``n_seen`` of a set that ``write_ordered`` wrote."""
    left = spark.read.parquet(path).where(F.col("block") >= n_seen // block_rows)
    return resume_from(left, n_seen, position).drop("block")


def prompt_masked_labels(df: DataFrame, prompt_tokens: Column) -> DataFrame:
    """Add ``labels``: the ids, with prompt and masked places set to -100."""
    labels = T.masked_labels(F.col("input_ids"), F.col("attention_mask"), prompt_tokens)
    return df.withColumn("labels", labels)


def with_longest(df: DataFrame, batch: str) -> DataFrame:
    """Add ``_longest``: the length of the longest row of each batch.

    Only one number per batch is shuffled besides the rows, which meet it once.
    """
    sizes = df.select(batch, F.size("input_ids").alias("_size"))
    return df.join(sizes.groupBy(batch).agg(F.max("_size").alias("_longest")), batch)


def bucket_pad(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad each batch to the smallest bucket that holds its longest row.

    ``df`` should be a written table: the lengths are read first, on their own.
    """
    target = T.bucket_length(F.col("_longest"))
    padded = with_longest(df, batch).withColumns(
        {
            "input_ids": T.pad_to(F.col("input_ids"), target, T.PAD_ID),
            "attention_mask": T.pad_to(F.col("attention_mask"), target, 0),
            "labels": T.pad_to(F.col("labels"), target, T.IGNORE_INDEX),
        }
    )
    return padded.drop("_longest")


def pad_to_batch_max(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pad each unlabelled batch to its longest row; ``df`` as in ``bucket_pad``."""
    target = F.col("_longest")
    padded = with_longest(df, batch).withColumns(
        {
            "input_ids": T.pad_to(F.col("input_ids"), target, T.PAD_ID),
            "attention_mask": T.pad_to(F.col("attention_mask"), target, 0),
        }
    )
    return padded.drop("_longest")


def pack_chunks(
    df: DataFrame,
    tokens: str = "input_ids",
    key: str = "doc_id",
    size: int = 512,
    overlap: int = 50,
    levels: list[Column] | None = None,
    order: list[Column] | None = None,
    by: list[str] | None = None,
    keep_tail: bool = False,
) -> DataFrame:
    """Cut the concatenation of all rows' tokens into overlapping chunks.

    Chunk k holds stream tokens ``[k * stride, k * stride + size)`` and exists
    only when full; with ``keep_tail`` the first unfinished one is kept too.
    A running total of lengths places each row in the stream; every row then
    sends only its slice to each chunk it meets, so no group exceeds a chunk.
    """
    by = by or []
    stride = size - overlap
    rows = df.withColumn("_n", F.size(tokens)).where("_n > 0")
    placed = running_total(
        rows, F.col("_n"), levels or id_levels(key), order or [F.col(key)], "_start", by
    )
    start, n = F.col("_start"), F.col("_n")
    first = F.greatest(F.floor((start - size) / stride) + 1, F.lit(0))
    last = F.floor((start + n - 1) / stride)

    def piece(k: Column) -> Column:
        low = F.greatest(k * stride - start, F.lit(0))
        high = F.least(k * stride + size - start, n)
        part = F.slice(F.col(tokens), (low + 1).cast("int"), (high - low).cast("int"))
        return F.struct(k.alias("chunk_id"), start.alias("start"), part.alias("part"))

    # Slices are cut inside the array expression, so the whole row is never copied.
    pieces = placed.select(
        *by, F.explode(F.transform(F.sequence(first, last), piece)).alias("_piece")
    )
    chunks = (
        pieces.groupBy(*by, F.col("_piece.chunk_id").alias("chunk_id"))
        .agg(F.sort_array(F.collect_list(F.struct("_piece.start", "_piece.part"))).alias("_parts"))
        .select(*by, "chunk_id", F.flatten("_parts.part").alias("input_ids"))
    )
    full = F.size("input_ids") == size
    if not keep_tail:
        chunks = chunks.where(full)
    else:
        # It starts with the overlap, while the one after it is shorter than that.
        chunks = chunks.where((F.col("chunk_id") == 0) | (F.size("input_ids") >= overlap))
    return chunks.withColumn("attention_mask", T.ones_like(F.col("input_ids")))


def next_token_pairs(df: DataFrame) -> DataFrame:
    """Inputs without the last token and labels one place ahead.

    Given ``labels`` are only shifted; else they come from ids and mask.
    """
    if "labels" in df.columns:
        labels = T.after_first(F.col("labels"))
    else:
        labels = T.next_labels(F.col("input_ids"), F.col("attention_mask"))
    return df.withColumns({"inputs": T.shifted_inputs(F.col("input_ids")), "labels": labels})
