"""Substring dedup on words (recompression) and bytes (suffixes) against brute force."""

import random

import numpy as np
import pytest

from millrace.llm import recompression, suffix_dedup
from millrace.llm.suffix_sort import sort_suffixes

from .conftest import order, pairs, words


def removed(rows, units, window):
    """Per row the units and which of them a window that starts earlier covers."""
    split = [(order(i), units(t)) for i, t in rows]
    first = {}
    for i, w in split:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, (i, p)), (i, p))
    for i, w in split:
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = True
        yield i, w, gone


def brute_words(rows, window=20):
    return sorted(
        (i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g))
        for i, w, gone in removed(rows, words, window)
    )


def brute_bytes(rows, window=100):
    return sorted(
        (
            i, len(w), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum() if len(w) else 0),
            bytes(x for x, g in zip(w, gone) if not g),
        )
        for i, w, gone in removed(rows, lambda t: (t or "").encode(), window)
    )


def by_words(df, **settings):
    found = recompression.remove_repeats(df, **settings).collect()
    return sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found)


def by_bytes(df, **settings):
    found = suffix_dedup.remove_repeats(df, **settings).collect()
    return sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)


@pytest.fixture(scope="module")
def shuffled_passages(spark):
    """Overlapping cuts of few-letter texts: many partial repeats and runs."""
    random.seed(5)
    two = [" ".join(random.choice("ab") for _ in range(random.randint(0, 110))) for _ in range(25)]
    long_ = "".join(random.choice("abcdefgh ") for _ in range(4000))
    for i in range(40):
        a, b = random.randint(0, 3700), random.randint(0, 3700)
        two.append("q%d " % i * random.randint(0, 9) + long_[a : a + random.randint(60, 300)] + " z " + long_[b : b + 160])
    two += [two[3], two[5] + " q " + two[7]] * 2
    return spark.createDataFrame(list(enumerate(two)), "doc_id long, text string")


def test_words_equal_brute_force(shuffled_passages):
    assert by_words(shuffled_passages) == brute_words(pairs(shuffled_passages))


def test_words_of_odd_rows(odd_rows):
    assert by_words(odd_rows) == brute_words(pairs(odd_rows))


def test_bytes_equal_brute_force(shuffled_passages):
    expected = brute_bytes(pairs(shuffled_passages))
    assert by_bytes(shuffled_passages) == expected
    assert by_bytes(shuffled_passages, hot=1) == expected  # every shared key as if it were hot


def test_bytes_of_odd_rows(odd_rows):
    assert by_bytes(odd_rows) == brute_bytes(pairs(odd_rows))


def test_given_documents(small_documents):
    rows = pairs(small_documents)
    assert by_words(small_documents) == brute_words(rows)
    assert by_bytes(small_documents) == brute_bytes(rows)


def test_no_documents(odd_rows):
    assert by_words(odd_rows.limit(0)) == [] == by_bytes(odd_rows.limit(0))


@pytest.mark.parametrize("letters", ["ab", "a" * 40 + "b"])
@pytest.mark.parametrize("depth", [20, 60, 100])
def test_suffixes_are_sorted_and_grouped(letters, depth):
    random.seed(depth)
    data = np.frombuffer("".join(random.choice(letters) for _ in range(1500)).encode(), np.uint8)
    start = np.array(random.sample(range(1380), 600))
    places, group = sort_suffixes(data, start, depth)
    found = [data[p : p + depth].tobytes() for p in start[places]]
    assert found == sorted(found)
    assert [a == b for a, b in zip(found, found[1:])] == (np.diff(group) == 0).tolist()
