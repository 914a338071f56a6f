"""Deep-shallow sorting of suffixes to a bounded depth, in numpy.

Suffixes are ordered by multikey quicksort on 8-byte characters down to ``SHALLOW``
bytes: one level sorts all groups that are still tied by their next character.  Groups
tied beyond it have a long common prefix and are ordered by blind tries: a node of the
trie is the first place where its suffixes differ (found by one comparison of each with
the group's first), and only the byte there parts them.  All tries grow a level at a
time, so there is no loop over suffixes or groups.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24


def characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number that compares like them."""
    words = np.ndarray(max(len(data) - 7, 0), ">u8", data, strides=(1,))
    return words[at].astype(np.uint64)


def group_numbers(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal neighbours in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def tied(group: np.ndarray) -> np.ndarray:
    """Members of groups of two or more, of sorted group numbers."""
    same = group[1:] == group[:-1]
    out = np.zeros(len(group), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def sort_suffixes(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``start`` by their first ``depth`` bytes, and for each
    in that order the number of its group of equal suffixes.

    ``data`` must reach ``depth`` bytes beyond every start.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    order, group = multikey(padded, start, min(SHALLOW, depth // 8 * 8))
    rank = group.astype(np.int64) << 32
    open_ = np.flatnonzero(tied(group))
    if len(open_):
        rank[open_] += blind_tries(padded, start[order[open_]], group[open_], min(SHALLOW, depth // 8 * 8), depth)
        again = np.argsort(rank, kind="stable")
        order, rank = order[again], rank[again]
    return order, group_numbers(rank)


def multikey(data: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and groups by the first ``depth`` bytes, a multiple of 8."""
    order = np.arange(len(start))
    group = np.zeros(len(start), np.int64)
    for at in range(0, depth, 8):
        open_ = np.flatnonzero(tied(group))
        if not len(open_):
            break
        character = characters(data, start[order[open_]] + at)
        moved = np.lexsort((character, group[open_]))
        order[open_] = order[open_[moved]]
        split = np.zeros(len(group), np.int64)
        split[open_[1:]] = (character[moved][1:] != character[moved][:-1]) & (group[open_][1:] == group[open_][:-1])
        group = group_numbers(group, np.cumsum(split))
    return order, group


def first_difference(data: np.ndarray, one: np.ndarray, two: np.ndarray, width: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``one`` and ``two`` share, up to ``width`` of them."""
    place = width.copy()
    open_ = np.flatnonzero(one != two)
    for at in range(0, int(width.max(initial=0)), 8):
        open_ = open_[width[open_] > at]
        other = characters(data, one[open_] + at) ^ characters(data, two[open_] + at)
        differ = other != 0
        found, other = open_[differ], other[differ]
        leading = np.zeros(len(found), np.int64)
        for shift in (32, 16, 8):  # zero bytes before the first that is not
            empty = other >> np.uint64(64 - shift) == 0
            leading[empty] += shift // 8
            other = np.where(empty, other << np.uint64(shift), other)
        place[found] = np.minimum(at + leading, width[found])
        open_ = open_[~differ]
    return place


def blind_tries(data: np.ndarray, start: np.ndarray, group: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Rank of each suffix inside its group; groups (sorted numbers) agree in ``known`` bytes."""
    rank = np.zeros(len(start), np.int64)
    member = np.arange(len(start))
    group = group_numbers(group)
    at = np.full(len(start), known)
    while len(member):
        # The first place where a group's members differ from its first one.
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        here = start[member] + at
        place = first_difference(data, here, here[first][group], depth - at)
        branch = np.minimum.reduceat(place, first)[group]
        open_ = np.flatnonzero(branch < depth - at)
        if not len(open_):
            break
        # Part the members by the byte at the branch; groups without one are equal.
        byte = data[here[open_] + branch[open_]]
        moved = np.lexsort((byte, group[open_]))
        order, byte = open_[moved], byte[moved]
        below = group_numbers(group[order], byte)
        # A child's rank is its first member's place in the node, so ranks stay ordered.
        heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
        inner = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        child = np.flatnonzero(np.concatenate([[True], below[1:] != below[:-1]]))
        rank[member[order]] += inner[child][below]
        left = tied(below)
        at = (at + branch + 1)[order][left]
        member, group = member[order][left], group_numbers(below[left])
    return rank
