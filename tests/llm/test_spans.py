"""Hashes of spans, and grouping by them."""

import random

import numpy as np

from millrace.llm import spans

from .conftest import COMPLEMENT, THUE_MORSE


def spans_of(words):
    data = np.frombuffer("".join(words).encode(), np.uint8)
    border = np.concatenate([[0], np.cumsum([len(w.encode()) for w in words])])
    return data, border[:-1], border[1:]


def test_equal_spans_have_equal_hashes_and_others_do_not():
    random.seed(1)
    words = ["".join(random.choices("ab", k=random.randint(0, 12))) for _ in range(3000)] + [THUE_MORSE, COMPLEMENT]
    data, start, end = spans_of(words)
    for bases in (spans.FIRST, spans.SECOND):
        hashes = spans.SpanHash(spans.BYTE_CODE[data], bases).of(start, end).tolist()
        assert len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))


def test_a_hash_is_the_polynomial_modulo_the_prime():
    codes = spans.mix(np.arange(1, 400, dtype=np.uint64))
    hashed = spans.SpanHash(codes)
    prime = int(spans.PRIME)
    for start, end in ((0, 399), (17, 300), (5, 5)):
        for lane, (base, shift) in enumerate(zip(spans.FIRST, (0, 33))):
            plain = sum((int(c) >> shift & prime) * pow(base, i, prime) for i, c in enumerate(codes[start:end])) % prime
            total = hashed.total[lane][end] - hashed.total[lane][start]
            got = spans.reduced(spans.reduced(np.array([total])) * hashed.down[lane][start])
            assert int(got[0]) == plain


def test_spans_that_differ():
    random.seed(4)
    base = "".join(random.choices("ab", k=700))
    words = ["", "a", base[:8], base[:9], base[:255], base[:256], base[:257], base]
    words += [w[:k] + "c" + w[k + 1 :] for w in words[1:] for k in {0, len(w) // 2, len(w) - 1}]
    words += words
    data, start, end = spans_of(words)
    for shift in (0, 1, len(words) // 2, 5):
        other = np.roll(np.arange(len(words)), shift)
        assert spans.differ(data, start, end, other).tolist() == [words[i] != words[j] for i, j in enumerate(other)]


def test_distinct_spans_are_told_apart_by_their_bytes(monkeypatch):
    random.seed(2)
    words = ["".join(random.choices("abc", k=random.randint(0, 4))) for _ in range(500)]
    data, start, end = spans_of(words)
    words += [THUE_MORSE, COMPLEMENT] * 3
    data, start, end = spans_of(words)
    whole = spans.QuickHash.of(data, start, end)
    assert whole[-1] == whole[-2]  # what the quick hash may do
    for mask in (2**64 - 1, 3):  # with a quick hash of two bits nearly all spans share one
        monkeypatch.setattr(spans.QuickHash, "of", lambda *a, mask=mask: whole & np.uint64(mask))
        one, two, where, number = spans.distinct_spans(data, start, end)
        monkeypatch.undo()
        assert [words[where[n]] for n in number] == words
        assert len(where) == len(one) == len(set(two.tolist())) == len(set(words))
        assert (one == (whole & np.uint64(mask))[where]).all()
