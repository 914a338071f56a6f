"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint bit is the majority of that bit over the hashes of all word shingles.  Two
fingerprints that differ in at most ``radius`` bits have a common variant that differs
from each in at most half of that.  So every distinct fingerprint emits all its variants
within half the radius (65 for a radius of 2), the shuffle brings equal variants together,
and colliding fingerprints are verified by their differing bits.

All members of a variant's group lie in one ball, which bounds the group by the size of
the ball however many documents there are, and nearly makes it a clique: each member is
paired with the one nearest to the variant only.  That keeps components whole: a path of
at most ``radius`` bits has a variant with one end within the larger and one within the
smaller half, and in its group the nearest member is close enough to both ends.  Pairs
found under several variants are one edge.  Equal fingerprints are one node before any
variant is made, so a large group of copies costs partial minima only.

Defined cases: null, empty and blank texts have the fingerprint zero, linked like any
other; texts with fewer words than a shingle are one shingle; a null id counts as the
smallest but is returned as null; rows that share an id are one document each, and the
class has the smallest id of all; equal rows get equal results; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components, keep_firsts
from millrace.llm.spans import LOWER, Texts, find_words, slices, spread_ranges
from millrace.sources.scratch import cut_lineage, free_table

SHINGLE = 3
SEED = 42
RADIUS = 2

NO_ID = -(2**63)
#: Shingles whose bits are counted at once.
STEP = 2**16


def shingle_hashes(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the slice, repeats included, and each text's number."""
    words = find_words(texts)
    length = words.end - words.start
    # All words again, each followed by one space: a shingle is then one run of bytes.
    place, _ = spread_ranges(words.start, length + 1)
    joined = LOWER[np.append(texts.data, np.uint8(0x20))[place]]
    after = np.cumsum(length + 1)
    joined[after - 1] = 0x20
    count = np.diff(words.first)
    windows = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    at, text = spread_ranges(words.first[:-1], windows)
    last = at + np.minimum(size, count[text]) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    starts, stops = (after[at] - length[at] - 1).tolist(), (after[last] - 1).tolist()
    found = (digest(data[i:j], SEED) for i, j in zip(starts, stops))
    return np.fromiter(found, np.uint64, len(starts)), windows


def majorities(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per run of ``count`` hashes: the bits that are set in over half of them."""
    ones = np.zeros((len(count), 64), np.int64)
    owner = np.repeat(np.arange(len(count)), count)
    for at in range(0, len(hashes), STEP):
        part = owner[at : at + STEP]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        bits = np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[part[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, id, print)``: every document's fingerprint as a signed number."""
    rows = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                found = majorities(*shingle_hashes(texts, size)).view(np.int64)
                columns = [texts.rows.column("doc_id"), texts.rows.column("id"), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "id", "print"])

    return rows.mapInArrow(measure, rows.select("doc_id", "id").schema.add("print", "long"))


def flips(radius: int) -> list[int]:
    """Signed masks of all sets of at most ``radius`` of 64 bits."""
    masks = [sum(1 << i for i in chosen) for n in range(radius + 1) for chosen in combinations(range(64), n)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def variants(prints: DataFrame, radius: int) -> DataFrame:
    """``(variant, far, print)`` of every fingerprint's ball; ``far`` bits are flipped."""
    masks = F.array(*[F.lit(m).cast("long") for m in flips(radius)])
    ball = prints.select("print", F.explode(masks).alias("mask"))
    return ball.select(F.col("print").bitwiseXOR(F.col("mask")).alias("variant"), F.bit_count("mask").alias("far"), "print")


def nearest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by variant and distance: every other member with its group's first.

    Only the first row of the open group is carried from batch to batch.
    """
    head = None
    for batch in batches:
        if not batch.num_rows:
            continue
        variant, own = (batch.column(c).to_numpy() for c in ("variant", "print"))
        if head is not None:
            variant, own = np.append(head[0], variant), np.append(head[1], own)
        new = np.concatenate([[True], variant[1:] != variant[:-1]])
        first = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
        head = variant[-1], first[-1]
        a, b = first[~new], own[~new]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints within ``radius`` bits."""
    ball = variants(prints, (radius + 1) // 2)
    met = ball.repartition("variant").sortWithinPartitions("variant", "far", "print")
    pairs = met.mapInArrow(nearest_pairs, "a long, b long").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document.

    ``component_id`` is the smallest id reached over links of at most ``radius`` bits.
    """
    marked = cut_lineage(fingerprints(documents, size), "prints")
    prints = cut_lineage(marked.groupBy("print").agg(F.min("id").alias("id")), "distinct_prints")
    edges = cut_lineage(links(prints.select("print"), radius), "links")
    classes = cut_lineage(components(edges).withColumnRenamed("node", "print"), "classes")
    free_table(edges)
    linked = prints.join(classes, "print")
    firsts = linked.groupBy("component").agg(F.min("id").alias("first"))
    firsts = linked.select("print", "component").join(firsts, "component").select("print", "first")
    # A written table: the join below can then split a fingerprint of very many documents.
    firsts = cut_lineage(prints.join(firsts, "print", "left").select("print", F.coalesce("first", "id").alias("first")), "firsts")
    for done in (prints, classes):
        free_table(done)
    return marked.join(firsts, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("first") != NO_ID, F.col("first")).alias("component_id"),
    )


def keep_one(documents: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``documents`` with the document of the smallest id of each component only."""
    return keep_firsts(documents, simhash_components(documents, size, radius))
