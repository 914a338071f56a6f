"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles.  Its parity sketch has ``P`` words,
each the XOR of the hashes of the shingles that fall into it: a shingle in one of two
sets only changes one word, so the number of words that differ is at most the symmetric
difference.  Sets that reach the threshold differ in at most ``d`` shingles, ``d``
following from the size band of the smaller one; with more than ``d`` words at least one
is equal, so equal words are the join keys.  Words without a shingle are no keys: ``P``
leaves room for some, and a set with more of them than that is sketched again under
other seeds, finally by all of its shingles, so no pair of such sets is lost.

A second sketch of one parity bit per cell bounds the difference of a candidate pair
from below (its Hamming distance) before the pair's texts are compared exactly.

Equal sets are one node, named by a hash; sets that another hash tells apart are nodes of
their own.  In a key's group, pairs are not enumerated: all members are
compared with one pivot, the one that shares most keys with most others; then only the
strays, members still outside the group's largest component, with members of other
components.  With more than ``MOST_STRAYS`` of them, their sketches are compared in blocks
of ``BLOCK`` by ``BLOCK``, spread over tasks, and only likely pairs leave a block.
Members of one component are never compared again, which loses no component.

Defined cases: null and empty texts have an empty set, linked with nothing; texts with
fewer words than a shingle are one shingle; equal texts are linked; a null id counts as
the smallest but is returned as null; rows that share an id are one document each, and
the id's component is the smallest id of all; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components, keep_firsts
from millrace.llm.spans import SpanHash, Texts, find_words, hash_words, mix, slices, spread_ranges
from millrace.sources.scratch import cut_lineage, free_table

SHINGLE = 5
#: Linked: 100 * intersection >= 80 * union.
PERCENT = 80

SEEDS = 8
MOST_STRAYS = 8
BLOCK = 2048

NO_ID = -(2**63)


class Shingles:
    """The distinct shingle hashes of each text of a slice, grouped by text."""

    def __init__(self, texts: Texts, size: int) -> None:
        words = find_words(texts)
        n = len(texts)
        count = np.diff(words.first)
        windows = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
        at, text = spread_ranges(words.first[:-1], windows)
        hashes = SpanHash(hash_words(texts, words, lower=True)).of(at, at + np.minimum(size, count[text]))
        salted = hashes ^ mix(np.arange(1, n + 1, dtype=np.uint64))[text]
        order = np.argsort(salted)
        keep = np.ones(len(hashes), bool)
        keep[order[1:]] = salted[order[1:]] != salted[order[:-1]]
        self.hash, self.text = hashes[keep], text[keep]
        self.count = np.bincount(self.text, minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def nodes(self, clashing: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each text's set; one of ``clashing`` is mixed with ``checks``."""
        nodes = self.set_hashes(0)
        if clashing is not None and len(clashing):
            shared = np.isin(nodes, clashing)
            nodes[shared] = mix(nodes[shared] ^ mix(self.checks()[shared]))
        return nodes

    def checks(self) -> np.ndarray:
        """Another hash of each set, independent of the first."""
        return self.set_hashes(1)

    def set_hashes(self, seed: int) -> np.ndarray:
        own = mix(self.hash ^ np.uint64(seed * 0xD1B54A32D192ED03))
        total = np.concatenate([[np.uint64(0)], np.cumsum(own, dtype=np.uint64)])
        return mix((total[self.first[1:]] - total[self.first[:-1]]) ^ mix(self.count.astype(np.uint64)))


@cache
def bands(upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First set size of each size band, the largest difference ``d`` of a linked pair
    whose smaller set is in the band, and the number of sketch words.

    The larger set of a linked pair is in the same band or in the next one.
    """
    low = [1, 2]
    while low[-1] <= upto:
        low.append(max(low[-1] + 1, 100 * (low[-1] - 1) // PERCENT + 1))
    most, words = [], []
    for high in low[1:]:
        total = (high - 1) + 100 * (high - 1) // PERCENT
        # At size a + b = s the intersection is at least s * PERCENT / (100 + PERCENT).
        d = max(s - 2 * -(-s * PERCENT // (100 + PERCENT)) for s in range(max(2, total - 20), total + 1))
        most.append(d)
        words.append(0 if d == 0 else d + 2 + (8 * (d + 2) + 99) // 100)
    return np.array(low[:-1]), np.array(most), np.array(words)


def sketch_keys(shingles: Shingles, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the texts flagged in ``keep``, and the text of each key."""
    low, most, words = bands(int(max(shingles.count.max(initial=1), 64)))
    own = np.searchsorted(low, shingles.count, "right") - 1
    keys, texts = [], []
    for step in (0, 1):
        band = own - step
        left = np.flatnonzero(keep & (shingles.count > 0) & (band >= 0))
        left = left[most[band[left]] > 0]
        for seed in range(SEEDS):
            if not len(left):
                break
            found, text, filled = words_of(shingles, left, band[left], words[band[left]], seed)
            keys.append(found)
            texts.append(text)
            # With no more than ``d`` words filled, all of them may differ.
            left = left[filled <= most[band[left]]]
        if len(left):
            place, row = spread_ranges(shingles.first[left], shingles.count[left])
            salt = mix(band[left].astype(np.uint64) * np.uint64(2**32) + np.uint64(2**31))
            keys.append(mix(shingles.hash[place] ^ salt[row]))
            texts.append(left[row])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(texts)


def words_of(
    shingles: Shingles, left: np.ndarray, band: np.ndarray, words: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the sketch words that have a shingle, their text, and how many each text
    of ``left`` has."""
    place, row = spread_ranges(shingles.first[left], shingles.count[left])
    salt = mix(band.astype(np.uint64) * np.uint64(2**32) + np.uint64(seed))
    hashes = mix(shingles.hash[place] ^ salt[row])
    base = np.cumsum(words) - words
    cell = base[row] + (hashes % words[row].astype(np.uint64)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    heads = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    parity = np.bitwise_xor.reduceat(mix(hashes[order]), heads)
    owner = row[order][heads]
    number = (cell[heads] - base[owner]).astype(np.uint64)
    keys = mix(parity ^ mix(number ^ salt[owner]))
    filled = np.bincount(owner, minlength=len(left))
    return keys, left[owner], filled


def bit_sketches(shingles: Shingles) -> pa.Array:
    """One parity bit per cell, a power of two of at least twice the set's size."""
    cells = np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * shingles.count, 1))).astype(np.int64))
    base = np.cumsum(cells) - cells
    at = base[shingles.text] + (shingles.hash & (cells[shingles.text] - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(at, minlength=int(cells.sum())) & 1).astype(np.uint8)
    data = np.packbits(parity, bitorder="little")
    border = np.concatenate([[0], np.cumsum(cells // 8)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(border), pa.py_buffer(data)])


#: 64-bit words of sketches that are compared at once.
COMPARED = 2**18


def sketch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 64-bit words of a column of bit sketches, and where each sketch begins and ends."""
    _, offsets, data = column.buffers()
    border = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    words = np.frombuffer(data[border[0] : border[-1]].tobytes(), np.uint64)
    return words, (border - border[0]) // 8


def hamming(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Cells in which the bit sketches of each pair differ; the longer one is folded first."""
    sides = [sketch_words(x) for x in (a, b)]
    sizes = np.stack([np.diff(border) for _, border in sides])
    found = np.zeros(len(a), np.int64)
    for widths in np.unique(sizes, axis=1).T:
        rows, narrow = np.flatnonzero((sizes == widths[:, None]).all(axis=0)), int(widths.min())
        step = max(1, COMPARED // int(widths.max()))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            one, two = (
                np.bitwise_xor.reduce(
                    words[border[part][:, None] + np.arange(width)].reshape(len(part), -1, narrow), axis=1
                )
                for (words, border), width in zip(sides, widths)
            )
            found[part] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
    return found


def set_table(rows: DataFrame, size: int) -> DataFrame:
    """``(doc_id, id, n, node, check, sketch)`` of every document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                shingles = Shingles(texts, size)
                columns = [
                    texts.rows.column("doc_id"), texts.rows.column("id"),
                    pa.array(shingles.count.astype(np.int64)),
                    *(pa.array(x.view(np.int64)) for x in (shingles.nodes(), shingles.checks())), bit_sketches(shingles),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    schema = rows.select("doc_id", "id").schema
    for name in ("n", "node", "check"):
        schema = schema.add(name, "long")
    schema = schema.add("sketch", "binary")
    return rows.select("doc_id", "id", "text").mapInArrow(measure, schema)


def told_apart(sets: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``sets`` whose node stands for one set only, and the hashes that several sets have.

    Of ``n`` sets about ``n * n / 2**65`` share a hash, ten of 2 * 10**10: few enough to be
    known to every task.
    """
    hashes = sets.groupBy("node").agg((F.min("check") != F.max("check")).alias("several"))
    clashing = hashes.where("several").select("node").toArrow().column("node").to_numpy().view(np.uint64)
    if not len(clashing):
        return sets, clashing

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, check = (batch.column(c).to_numpy().view(np.uint64).copy() for c in ("node", "check"))
            shared = np.isin(node, clashing)
            node[shared] = mix(node[shared] ^ mix(check[shared]))
            place = batch.schema.get_field_index("node")
            yield batch.set_column(place, "node", pa.array(node.view(np.int64)))

    return cut_lineage(sets.mapInArrow(rename, sets.schema), "sets"), clashing


def node_texts(rows: DataFrame, nodes: DataFrame, size: int, clashing: np.ndarray) -> DataFrame:
    """``(node, text)``: a text of each of ``nodes``, from the rows that have its id.

    Rows that share an id may have other texts, so each text's own node decides.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task give one text
        for batch in batches:
            for texts in slices(batch):
                own = Shingles(texts, size).nodes(clashing).view(np.int64)
                right = own == texts.rows.column("node").to_numpy()
                for i in np.flatnonzero(right).tolist():
                    right[i] = int(own[i]) not in seen
                    seen.add(int(own[i]))
                yield texts.rows.select(["node", "text"]).filter(pa.array(right))

    found = rows.select("id", "text").join(nodes.select("id", "node").hint("shuffle_hash"), "id")
    found = found.select("node", "text").mapInArrow(keep, "node long, text string")
    return found.groupBy("node").agg(F.first("text").alias("text"))


def key_table(rows: DataFrame, size: int, clashing: np.ndarray) -> DataFrame:
    """``(key, node)``: the join keys of every set, without keys that only one set has."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task give their keys once
        for batch in batches:
            for texts in slices(batch):
                shingles = Shingles(texts, size)
                nodes = shingles.nodes(clashing).view(np.int64)
                new = np.zeros(len(texts), bool)
                for i, node in enumerate(nodes.tolist()):
                    new[i] = node not in seen
                    seen.add(node)
                keys, text = sketch_keys(shingles, new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(nodes[text])], ["key", "node"]
                )

    return shared_keys(rows.select("text").mapInArrow(emit, "key long, node long"))


def shared_keys(found: DataFrame) -> DataFrame:
    """Distinct ``(key, node)`` rows of keys with more than one node."""
    ordered = found.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(several_nodes, "key long, node long")


def several_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: distinct rows of keys with more than one node.

    One row is carried from batch to batch, however many rows a key has.
    """
    last, given = None, False  # the row before this batch; whether its key has several
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (batch.column(c).to_numpy() for c in ("key", "node"))
        if last is not None:
            key, node = np.append(last[0], key), np.append(last[1], node)
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[fresh], node[fresh]
        several = np.zeros(len(key), bool)
        several[1:] = key[1:] == key[:-1]
        several[:-1] |= several[1:]
        several[0] |= given
        out = several.copy()
        out[0] &= not given
        last, given = (key[-1], node[-1]), bool(several[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], ["key", "node"])


def likely_in_blocks(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Likely pairs ``(a, b)`` of strays with all others, of groups with many strays.

    ``members`` has ``(key, node, class, main, strays, members)``.  Strays and members of a
    key are cut into parts of about ``BLOCK``; every block of two parts is a group of its
    own, in which bit sketches are compared by numpy and only likely pairs are given out.
    """
    rows = members.join(nodes.select("node", "n", "sketch"), "node")
    parts = {c: F.ceil(F.col(c) / BLOCK) for c in ("strays", "members")}
    own = {c: F.pmod(F.xxhash64("node"), count) for c, count in parts.items()}
    every = {c: F.explode(F.sequence(F.lit(0).cast("long"), count - 1)) for c, count in parts.items()}
    columns = ["node", "class", "n", "sketch"]
    stray = F.col("class") != F.col("main")
    blocks = rows.where(stray).select(
        "key", own["strays"].alias("i"), every["members"].alias("j"), F.lit(0).alias("side"), *columns
    )
    blocks = blocks.union(
        rows.select("key", every["strays"].alias("i"), own["members"].alias("j"), F.when(stray, 1).otherwise(2).alias("side"), *columns)
    )
    block = ["key", "i", "j"]
    dealt = blocks.repartition(*block).sortWithinPartitions(*block, "side")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            rows = pa.Table.from_batches(waiting)
            marks = np.stack([rows.column(c).to_numpy() for c in block])
            new = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            edges = [0, *new.tolist()]
            for start, stop in zip(edges, edges[1:]):
                yield from compare_block(rows.slice(start, stop - start))
            waiting = rows.slice(edges[-1]).combine_chunks().to_batches()
        if waiting:
            yield from compare_block(pa.Table.from_batches(waiting))

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def compare_block(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of a stray (side 0) and another class's member of one block that their sizes
    and sketches allow to be linked; pairs of strays once."""
    side, node, own_class, n = (rows.column(c).to_numpy() for c in ("side", "node", "class", "n"))
    sketches = [np.frombuffer(x, np.uint64) for x in rows.column("sketch").to_pylist()]
    width = min(map(len, sketches), default=0)
    folded = np.empty((len(sketches), width), np.uint64)
    for i, x in enumerate(sketches):
        folded[i] = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    step = max(1, 2**20 // max(1, len(two) * width))
    for at in range(0, len(one), step):
        left = one[at : at + step]
        total = n[left][:, None] + n[two]
        most = total - 2 * -(-total * PERCENT // (100 + PERCENT))
        apart = np.bitwise_count(folded[left][:, None, :] ^ folded[two]).sum(axis=2, dtype=np.int64)
        keep = (apart <= most) & (own_class[left][:, None] != own_class[two])
        keep &= 100 * np.minimum(n[left][:, None], n[two]) >= PERCENT * np.maximum(n[left][:, None], n[two])
        keep &= (side[two] == 2) | (node[left][:, None] < node[two])
        i, j = np.nonzero(keep)
        a, b = node[left[i]], node[two[j]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes and bit sketches allow a link."""
    sized = pairs
    for side in ("a", "b"):
        columns = [F.col(c).alias(f"{c}_{side}") for c in ("n", "sketch")]
        sized = sized.join(nodes.select(F.col("node").alias(side), *columns), side)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    total = F.col("n_a") + F.col("n_b")
    most = total - 2 * F.ceil(total * PERCENT / (100.0 + PERCENT))
    sized = sized.where(100 * small >= PERCENT * large).withColumn("most", most)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = hamming(batch.column("sketch_a"), batch.column("sketch_b")) <= batch.column("most").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", "sketch_a", "sketch_b", "most").mapInArrow(sift, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sets reach the threshold, compared exactly."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                left = Shingles(part, size)
                rows = part.rows
                other = next(slices(rows, "text_b", limit=2**40))
                right = Shingles(other, size)
                salt = mix(np.arange(1, len(part) + 1, dtype=np.uint64))
                one, two = (mix(x.hash ^ salt[x.text]) for x in (left, right))
                common = left.text[np.isin(one, two)]
                shared = np.bincount(common, minlength=len(part))
                union = left.count + right.count - shared
                keep = (100 * shared >= PERCENT * union) & (union > 0)
                yield rows.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def weighed(keys: DataFrame) -> DataFrame:
    """``(key, node, weight)``: a node weighs the sizes of all groups that it is in.

    The original of many edited copies shares most keys with most of them.
    """
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = keys.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    return cut_lineage(keys.join(weights, "node").select("key", "node", "weight"), "keys")


def joined_classes(classes: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, component)`` after the new ``links (a, b)`` between nodes."""
    if classes is None:
        return cut_lineage(components(links), "classes")
    edges = links
    for side in ("a", "b"):
        own = classes.select(F.col("node").alias(side), F.col("component").alias(f"class_{side}"))
        edges = edges.join(own, side, "left")
    edges = edges.select(*[F.coalesce(f"class_{c}", c).alias(c) for c in ("a", "b")])
    merged = cut_lineage(components(edges), "merged").select(F.col("node").alias("component"), F.col("component").alias("into"))
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    new = nodes.join(classes, "node", "left_anti").select("node", F.col("node").alias("component"))
    moved = classes.unionByName(new).join(merged, "component", "left")
    return cut_lineage(moved.select("node", F.coalesce("into", "component").alias("component")), "classes")


def link(keys: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame | None:
    """``(node, component)`` of linked nodes, from the groups ``keys (key, node)``."""
    # All members of a group against its heaviest one.
    keys = weighed(keys)
    pivots = keys.groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("pivot"))
    pairs = keys.join(pivots, "key").where("node != pivot")
    pairs = pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    found = cut_lineage(verified(likely(pairs.distinct(), nodes), texts, size), "links")
    classes = None if found.isEmpty() else joined_classes(None, found)

    # Every group's largest class, and the strays outside it against all other classes.
    placed = keys.withColumn("class", F.col("node"))
    if classes is not None:
        placed = keys.join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    sizes = placed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("inside"))
    groups = sizes.groupBy("key").agg(
        F.max(F.struct("inside", "class")).getField("class").alias("main"),
        F.sum("inside").alias("members"),
        (F.sum("inside") - F.max("inside")).alias("strays"),
    ).where("strays > 0")
    open_ = cut_lineage(placed.select("key", "node", "class").join(groups, "key"), "groups")
    few = F.col("strays") <= MOST_STRAYS
    stray = F.col("class") != F.col("main")
    strays = open_.where(few & stray).select("key", F.col("node").alias("a"), F.col("class").alias("class_a"))
    rest = open_.where(few).select("key", F.col("node").alias("b"), "class", stray.alias("stray"))
    across = strays.join(rest, "key").where("class_a != class AND (NOT stray OR a < b)")
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    candidates = likely(across, nodes).union(likely_in_blocks(open_.where(~few), nodes)).distinct()
    found = cut_lineage(verified(candidates, texts, size), "links")
    return classes if found.isEmpty() else joined_classes(classes, found)


def jaccard_components(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every document."""
    rows = documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sets, clashing = told_apart(cut_lineage(set_table(rows, size), "sets"))
    keys = cut_lineage(key_table(rows, size, clashing), "keys")
    candidates = keys.select("node").distinct()
    filled = sets.where("n > 0")
    nodes = filled.groupBy("node").agg(
        F.min("id").alias("id"), F.min("n").alias("n"), F.min("sketch").alias("sketch")
    )
    nodes = cut_lineage(nodes.join(candidates, "node", "left_semi"), "nodes")
    texts = cut_lineage(node_texts(rows, nodes, size, clashing), "texts")
    classes = link(keys, nodes, texts, size)
    for done in (keys, nodes, texts):
        free_table(done)

    # A document's class is its set's node, or the component that the node is in.
    if classes is not None:
        classes = classes.withColumnRenamed("component", "class")
        filled = filled.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    else:
        filled = filled.withColumn("class", F.col("node"))
    members = filled.select("doc_id", "id", "n", "class")
    # A written table: the join below can then split a class of very many documents.
    firsts = cut_lineage(members.groupBy("class").agg(F.min("id").alias("component")), "firsts")
    placed = members.join(firsts, "class").select("doc_id", "id", "n", "component")
    alone = sets.where("n = 0").select("doc_id", "id", "n", F.col("id").alias("component"))
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return placed.union(alone).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``documents`` with the document of the smallest id of each component only.

    Rows that share an id are one document: they stay or go together.
    """
    return keep_firsts(documents, jaccard_components(documents, size))
