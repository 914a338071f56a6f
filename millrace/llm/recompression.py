"""Substring dedup on words by recompression.

Rounds of recompression rename a text: first maximal runs of one symbol become a symbol,
then pairs of a left and a right symbol (a symbol's side is a bit of its name).  A new
name is a hash of what it stands for, so equal runs and pairs have one name everywhere
without exchange.  Each symbol knows the words that determine it: its own and the
neighbours that show a run's end or a pair's side.  All symbols determined inside a
window are consistent, so equal windows have the same ones at the same places; the
window's anchor is its highest symbol, of these the one with the least hash.

All rounds run per text, in one Arrow function; no Spark round names runs or pairs, and
symbols only choose anchors.  Spark then counts the names of anchors once, drops those met
once, settles the contexts of a name by their hashes, and compares single windows where
contexts differ.  A window is removed if its words start earlier somewhere.

Defined cases: null and empty texts have no words (the digest of the empty text); texts
shorter than a window lose nothing; a null id sorts first; rows with one id are told
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
    PLACE_BITS,
    by_document,
    covered,
    earlier_elsewhere,
    found_ranges,
    group_windows,
    keyed,
    place_of,
    repeated_anchors,
    settled,
)
from millrace.llm.spans import (
    FIRST,
    SECOND,
    SpanHash,
    Texts,
    Words,
    find_words,
    hash_words,
    mix,
    slices,
    spread_ranges,
)
from millrace.sources.scratch import cut_lineage

WINDOW = 20
ROUNDS = 3
FAR = 2**40

RUN = np.array([0x52554E], np.uint64)
PAIR = np.array([0x50414952], np.uint64)
SIDE = np.array([0x53494445], np.uint64)


class Symbols:
    """A renamed slice: name, text, extent and determining words of each symbol."""

    def __init__(self, name, text, start, end, low, high):
        self.name, self.text, self.start, self.end = name, text, start, end
        self.low, self.high = low, high

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Least word that determines the symbol before each, largest of the one after;
        out of reach at the borders of a text."""
        low = np.full(len(self.name), -FAR)
        high = np.full(len(self.name), FAR)
        joined = self.text[1:] == self.text[:-1]
        low[1:][joined] = self.low[:-1][joined]
        high[:-1][joined] = self.high[1:][joined]
        return low, high

    def runs(self) -> Symbols:
        """Each maximal run of one name becomes one symbol."""
        n = len(self.name)
        if not n:
            return self
        opens = np.ones(n, bool)
        opens[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], n) - 1
        size = (last - first + 1).astype(np.uint64)
        low, high = self.neighbours()
        name = self.name[first]
        name = np.where(size > 1, mix(name ^ mix(size ^ RUN)), name)
        return Symbols(
            name, self.text[first], self.start[first], self.end[last],
            np.minimum(low[first], self.low[first]), np.maximum(high[last], self.high[last]),
        )

    def pairs(self, round_: int) -> Symbols:
        """A left symbol and a right one after it become one symbol."""
        n = len(self.name)
        if not n:
            return self
        right = (mix(self.name ^ mix(SIDE + np.uint64(round_))) & np.uint64(1)) > 0
        joined = np.zeros(n, bool)  # with the symbol after it
        joined[:-1] = ~right[:-1] & right[1:] & (self.text[1:] == self.text[:-1])
        second = np.zeros(n, bool)
        second[1:] = joined[:-1]
        low, high = self.neighbours()
        alone = ~joined & ~second
        new_low = np.where(alone & right, np.minimum(self.low, low), self.low)
        new_high = np.where(alone & ~right, np.maximum(self.high, high), self.high)
        first = np.flatnonzero(~second)
        last = first + joined[first]
        name = self.name[first]
        paired = mix(mix(name ^ PAIR) + self.name[last])
        return Symbols(
            np.where(joined[first], paired, name), self.text[first], self.start[first], self.end[last],
            new_low[first], new_high[last],
        )


def rounds(hashes: np.ndarray, words: Words) -> list[Symbols]:
    """The symbols of a slice after 0, 1, .. rounds."""
    at = np.arange(len(words))
    levels = [Symbols(hashes, words.text_of(), at, at + 1, at, at + 1)]
    for round_ in range(ROUNDS):
        levels.append(levels[-1].runs().pairs(round_))
    return levels


def least_over_ranges(low: np.ndarray, high: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` places the least key of the ranges ``low..high`` over it."""
    none = np.uint64(2**64 - 1)
    length = high - low + 1
    level = np.floor(np.log2(np.maximum(length, 1))).astype(np.int64)
    table = np.full(size, none)
    for k in range(int(level.max(initial=0)), -1, -1):
        step = 1 << k
        if k < int(level.max(initial=0)):  # each block of the level above is two of this
            half = np.full(size, none)
            half[step:] = table[: size - step] if step < size else half[step:]
            table = np.minimum(table, half)
        here = level == k
        np.minimum.at(table, low[here], keys[here])
        np.minimum.at(table, high[here] - step + 1, keys[here])
    return table


def choose_symbols(levels: list[Symbols], hashes: np.ndarray, words: Words, window: int) -> tuple[np.ndarray, ...]:
    """``(window, text, name, first word)`` of every window's anchor."""
    size = len(words)
    text = words.text_of()
    places = np.arange(size)
    wanted = places + window <= words.first[1:][text] if size else np.zeros(0, bool)
    anchor = np.full(size, -1)
    name = np.zeros(size, np.uint64)
    span = SpanHash(hashes)
    for depth in range(len(levels) - 1, -1, -1):
        here = levels[depth]
        low, high = here.high - window, here.low
        inside = low <= high
        border = words.first[here.text]
        low = np.maximum(low, border)
        high = np.minimum(high, words.first[here.text + 1] - window)
        open_ = np.concatenate([[0], np.cumsum(wanted & (anchor < 0))])
        inside &= low <= high
        inside[inside] = open_[high[inside] + 1] > open_[low[inside]]
        chosen = np.flatnonzero(inside)
        if not len(chosen):
            continue
        bits = np.uint64(PLACE_BITS)
        keys = (mix(here.name[chosen] + np.uint64(depth)) >> bits << bits) | chosen.astype(np.uint64)
        least = least_over_ranges(low[chosen], high[chosen], keys, size)
        new = wanted & (anchor < 0) & (least != np.uint64(2**64 - 1))
        symbol = place_of(least[new])
        anchor[new] = here.start[symbol]
        # All that determines the symbol lies in the window: a more telling name.
        name[new] = mix(here.name[symbol] + np.uint64(depth)) ^ span.of(here.low[symbol], here.high[symbol])
    at = np.flatnonzero(wanted)
    return at, text[at], name[at], anchor[at]


def find_anchors(texts: Texts, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchor rows of a slice (see ``anchors``), in words."""
    words = find_words(texts)
    hashes = hash_words(texts, words)
    at, text, name, symbol = choose_symbols(rounds(hashes, words), hashes, words, window)
    first, count = group_windows(at, text, symbol, name)
    lo = at[first]
    off = symbol[first] - lo
    context = SpanHash(hashes).of(lo, lo + count - 1 + window)
    context = mix(context ^ mix((off * 2**32 + count).astype(np.uint64)))
    return name[first], text[first], lo - words.first[text[first]], count, off, context


def window_rows(rows: DataFrame, unsettled: DataFrame, window: int) -> DataFrame:
    """``(h1, h2, id, mark, lo, again)`` of each single window of unsettled rows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                words = find_words(texts)
                one = hash_words(texts, words)
                two = hash_words(texts, words, bases=SECOND)
                text, lo, m = found_ranges(texts.rows)
                place, owner = spread_ranges(lo, m)
                at = place + words.first[text[owner]]
                h1, h2 = (SpanHash(h, bases).of(at, at + window) for h, bases in ((one, FIRST), (two, SECOND)))
                same = mix(h1 ^ mix(text[owner].astype(np.uint64)))
                order = np.lexsort((place, same))
                again = np.zeros(len(same), bool)
                again[order[1:]] = same[order[1:]] == same[order[:-1]]
                ids, marks = (texts.rows.column(c).to_numpy()[text[owner]] for c in ("id", "mark"))
                columns = (h1.view(np.int64), h2.view(np.int64), ids, marks, place.astype(np.int32), again)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["h1", "h2", "id", "mark", "lo", "again"]
                )

    joined = by_document(rows, unsettled, "lo", "m").select("id", "mark", "text", "found")
    return joined.mapInArrow(explode, "h1 long, h2 long, id long, mark int, lo int, again boolean")


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """``(id, mark, lo, m)``: ranges of windows that occur earlier, of ``keyed`` rows."""
    later, unsettled = settled(repeated_anchors(rows, lambda texts: find_anchors(texts, window)))
    single = window_rows(rows, unsettled, window)
    return later.union(earlier_elsewhere(cut_lineage(single, "windows")))


def remove_repeats(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: every document's words, without those of
    windows that start earlier, joined by one space."""
    rows = keyed(documents)
    spans = cut_lineage(repeated_windows(rows, window), "repeats")
    lists = spans.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "m")).alias("found"))
    whole = rows.join(lists.hint("shuffle_hash"), ["id", "mark"], "left")
    whole = whole.select("doc_id", "text", F.coalesce("found", F.array().cast("array<struct<lo:int,m:int>>")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                words = find_words(texts)
                text, lo, m = found_ranges(texts.rows)
                gone = covered(words.first[text] + lo, m - 1 + window, len(words))
                total = np.concatenate([[0], np.cumsum(gone)])
                n_words, n_removed = np.diff(words.first), np.diff(total[words.first])
                kept = np.flatnonzero(~gone)
                # A space goes with every kept word but a text's first.
                data, size = kept_words(texts, words, kept, words.text_of()[kept])
                border = np.concatenate([[0], np.cumsum(size)])
                text_column = pa.Array.from_buffers(
                    pa.string(), len(size), [None, pa.py_buffer(border.astype(np.int32)), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays(
                    [texts.rows.column("doc_id"), pa.array(n_words), pa.array(n_removed), text_column],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    schema = whole.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    return whole.mapInArrow(cut, schema)


def kept_words(texts: Texts, words: Words, kept: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, one space between those of a text, and each text's size."""
    size = words.end[kept] - words.start[kept]
    follows = np.zeros(len(kept), np.int64)
    follows[1:] = owner[1:] == owner[:-1]
    place, word = spread_ranges(words.start[kept] - follows, size + follows)
    data = texts.data[place] if len(place) else np.zeros(0, np.uint8)
    heads = np.cumsum(size + follows) - (size + follows)
    data[heads[follows > 0]] = 0x20
    return data, np.bincount(owner, size + follows, len(texts)).astype(np.int64)
