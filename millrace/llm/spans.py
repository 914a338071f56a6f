"""Words and lines of Arrow text batches as numpy spans with 62-bit hashes.

A batch is cut into slices of a few MB of text (one text at least), so the working
arrays of a task stay within a small multiple of ``SLICE_BYTES`` or, if that is
longer, of its longest text.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2**19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER_CODE = BYTE_CODE[LOWER]


#: Spans are hashed modulo this prime, in two lanes with a base and half of a code each.
PRIME = np.uint64(2**31 - 1)
LANE_BITS = np.uint64(31)
CODE_SHIFTS = (np.uint64(0), np.uint64(33))
#: Bases of the lanes, all of them generators modulo the prime; hashes under ``FIRST`` and
#: ``SECOND`` are independent of each other.
FIRST = (742938285, 950706376)
SECOND = (1226874159, 62089911)


def folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**32 (2**33 if ``x`` has 63 bits) that equal ``x`` modulo the prime."""
    low = x & PRIME
    low += x >> LANE_BITS
    return low


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, for numbers of 63 bits."""
    x = folded(folded(x))
    x[x >= PRIME] -= PRIME
    return x


class Powers:
    """Powers of a base and of its inverse modulo the prime, grown as longer arrays come.

    They stay with the worker, so they are kept in 32 bits.
    """

    def __init__(self, base: int) -> None:
        self.base = base
        self.up = np.ones(1, np.uint32)
        self.down = np.ones(1, np.uint32)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) <= n:
            size, prime = len(self.up), int(PRIME)
            step = pow(self.base, size, prime)
            for name, factor in (("up", step), ("down", pow(step, -1, prime))):
                powers = getattr(self, name)
                further = reduced(powers.astype(np.uint64) * np.uint64(factor))
                setattr(self, name, np.append(powers, further.astype(np.uint32)))
        return self.up, self.down


POWERS = {base: Powers(base) for base in FIRST + SECOND}


class SpanHash:
    """Hashes of spans of a sequence of 64-bit codes: equal spans, equal hashes.

    Polynomials modulo a prime: unlike modulo a power of two, no fixed pair of long
    sequences has equal hashes whatever the codes of its symbols.
    """

    def __init__(self, codes: np.ndarray, bases: tuple[int, int] = FIRST) -> None:
        n = len(codes)
        self.down, self.total = [], []
        for base, shift in zip(bases, CODE_SHIFTS):
            up, down = POWERS[base].upto(n)
            term = codes >> shift
            term &= PRIME
            term *= up[:n]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(folded(term), out=total[1:])
            del term
            self.down.append(down)
            self.total.append(total)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        lanes = []
        for total, down in zip(self.total, self.down):
            # Prefix sums stay below 2**63 for up to 2**31 codes.
            lanes.append(reduced(reduced(total[end] - total[start]) * down[start]))
        plain = lanes[0] << LANE_BITS | lanes[1]
        return mix(plain ^ ((end - start).astype(np.uint64) * np.uint64(BASE)))


class QuickHash:
    """Powers modulo 2**64: quick, but unequal spans of regular texts may have equal hashes.

    Only for groups that are compared byte by byte, or beside another hash.
    """

    up = down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = max(n + 1, SLICE_BYTES + 1)
            cls.up, cls.down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2**64), np.uint64)
            for values in (cls.up, cls.down):
                values[0] = 1
                np.multiply.accumulate(values, out=values)

    @classmethod
    def of(cls, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        cls.powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * cls.up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * cls.down[start] ^ (end - start).astype(np.uint64))


@dataclass
class Texts:
    """A slice of a batch: its rows, all their bytes and where each text begins."""

    rows: pa.RecordBatch
    data: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of ``batch`` in slices of bounded text; a null text has no bytes."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, total[at] + limit, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        part = texts.slice(at, to - at)
        if part.null_count:
            part = pc.fill_null(part, b"" if pa.types.is_binary(part.type) else "")
        wide = pa.types.is_large_string(part.type) or pa.types.is_large_binary(part.type)
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
        start = offsets[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        yield Texts(batch.slice(at, to - at), data[start[0] : start[-1]], start - start[0])
        at = to


@dataclass
class Words:
    """Word spans of a slice; ``first[i]:first[i+1]`` are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(texts: Texts) -> Words:
    """Maximal runs of other than space and the controls 9 to 13, inside each text."""
    inside = ~SPACE[texts.data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    border = texts.start[1:-1]
    border = border[(border > 0) & (border < len(inside))]
    opens[border] |= inside[border]
    closes[border - 1] |= inside[border - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, texts.start))


def hash_words(texts: Texts, words: Words, lower: bool = False, bases: tuple[int, int] = FIRST) -> np.ndarray:
    codes = (LOWER_CODE if lower else BYTE_CODE)[texts.data]
    return SpanHash(codes, bases).of(words.start, words.end)


def window_hashes(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of ``size`` words inside one text."""
    at = np.arange(max(0, len(hashes) - size + 1))
    owner = words.text_of()
    at = at[owner[at] == owner[at + size - 1]] if len(at) else at
    return at, SpanHash(hashes).of(at, at + size)


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``values`` as a list column with the borders ``first``."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))


def spread_ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``start``: each number and its range."""
    owner = np.repeat(np.arange(len(start)), count)
    before = np.cumsum(count) - count
    return np.arange(len(owner)) - before[owner] + start[owner], owner


def span_strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans' bytes as an Arrow string column."""
    place, _ = spread_ranges(start, end - start)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[place]))]
    return pa.Array.from_buffers(pa.string(), len(start), buffers)


def take_ranges(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[first[i]:first[i + 1]]`` for each i of ``which``, joined, and the lengths."""
    count = (first[1:] - first[:-1])[which]
    place, _ = spread_ranges(first[which], count)
    return values[place], count


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in ascending order, and each key's number."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after the other, and the borders between them."""
    place, _ = spread_ranges(start, end - start)
    return data[place], np.concatenate([[0], np.cumsum(end - start)])


#: Bytes of a span that are compared for many spans at once.
COMPARED = 256


def differ(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has other bytes than the span numbered ``other[i]``."""
    size = end - start
    apart = size != size[other]
    eights = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    left = np.flatnonzero(~apart & (size > 0) & (other != np.arange(len(other))))
    for at in range(0, COMPARED, 8):
        if not len(left):
            break
        unequal = eights[start[left] + at] ^ eights[start[other[left]] + at]
        # Bytes behind the span's end do not count.
        unequal <<= ((8 - np.minimum(size[left] - at, 8)) * 8).astype(np.uint64)
        apart[left[unequal != 0]] = True
        left = left[(unequal == 0) & (size[left] > at + 8)]
    for i in left.tolist():
        apart[i] = (data[start[i] : end[i]] != data[start[other[i]] : end[other[i]]]).any()
    return apart


def distinct_spans(
    data: np.ndarray, start: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The quick hash and the hash modulo a prime of each distinct span, a place of it, and
    each span's number.

    Spans are grouped by the quick hash, in ascending order, and compared byte by byte with
    the first of their group; those that differ from it are told apart by their bytes and
    come last.
    """
    quick = QuickHash.of(data, start, end)
    where, number = distinct(quick)
    odd = np.flatnonzero(differ(data, start, end, where[number]))
    if len(odd):
        found: dict[bytes, int] = {}
        added: list[int] = []
        for i in odd.tolist():
            number[i] = found.setdefault(data[start[i] : end[i]].tobytes(), len(where) + len(added))
            if number[i] == len(where) + len(added):
                added.append(i)
        where = np.append(where, np.array(added, where.dtype))
    names, border = joined(data, start[where], end[where])
    return quick[where], SpanHash(BYTE_CODE[names]).of(border[:-1], border[1:]), where, number
