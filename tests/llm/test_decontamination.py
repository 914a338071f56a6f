"""Decontamination against its rules written out window by window."""

import random
from collections import defaultdict

import pytest
import regex

from millrace.llm import decontamination as D

from .conftest import pairs

MARK = D.MARK


def parted(text):
    text = regex.sub(r"([0-9])[.,](?=[0-9])", rf"\1{D.POINT}", text)
    text = regex.sub(r"([$€£]) ?(?=[0-9])", rf" {D.POINT}\1 ", text)
    text = regex.sub(r"([0-9]) ?([%€£])", rf"\1 {D.POINT}\2 ", text)
    units = "|".join(D.UNITS)
    return regex.sub(rf"([0-9])(?=(?i:{units})(?![\p{{L}}\p{{N}}\p{{M}}]))", r"\1 ", text)


def named(text):
    return regex.sub(rf"(?<![\p{{L}}\p{{N}}\p{{M}}])({D.NAME}[\p{{L}}\p{{M}}]*) (?={D.NAME})", rf"\1{D.JOINED}", text)


def tokens(text, plain):
    found = regex.split(D.SEPARATOR, parted(text).lower() if plain else named(parted(text)))
    return [t for t in found if t]


def only_starts(text):
    marked = regex.sub(rf"(^|[.!?:\n][ \t\n\x0b\f\r]*)(?={D.NAME})", rf"\1 {D.START} ", named(parted(text)))
    words = [t for t in regex.split(D.SEPARATOR, marked) if t]
    after = [i > 0 and words[i - 1] == D.START for i in range(len(words))]
    starts = {w.lower() for w, a in zip(words, after) if a}
    return starts - {w.lower() for w, a in zip(words, after) if not a and regex.match(D.NAME, w)}


def valued(words):
    out = []
    for i, word in enumerate(words):
        low = word.lower()
        if regex.match(D.NUMBER, word):
            out.append(f"{MARK}n:{low}")
        elif word.startswith(D.POINT):
            out.append(f"{MARK}u:{word[1]}")
        elif regex.match(D.NAME, word):
            out.append(f"{MARK}p:{low}")
        elif low in D.UNITS and i and regex.match(D.NUMBER, words[i - 1]):
            out.append(f"{MARK}u:{low}")
        else:
            out.append(low)
    return out


def windows(text, plain):
    """``(places, tokens)`` of an item's windows with words enough, and its length."""
    words = tokens(text, plain)
    if len(words) < (D.LEAST_TOKENS if plain else D.WINDOW):
        return [], len(words)
    loose = only_starts(text)
    if not plain:
        words = [D.LOOSE + w[3:] if w.startswith(f"{MARK}p:") and w[3:] in loose else w for w in valued(words)]
    size = min(len(words), D.WINDOW)
    every = [(i, words[i : i + size]) for i in range(len(words) - size + 1)]
    return [(i, w) for i, w in every if sum(not t.startswith(MARK) for t in w) >= D.LEAST_LITERAL], len(words)


def fits(theirs, ours):
    return theirs == ours or theirs.startswith(MARK) and theirs[:2] == ours[:2]


def longest_run(ats, size):
    most = run = 0
    for at in sorted(ats):
        run = run + 1 if at - 1 in ats else 1
        most = max(most, run)
    return most + size - 1


def held(document, item, plain):
    """Coverage and numbers of windows if the document holds the item, by one kind of token."""
    found, n_tokens = windows(item, plain)
    if not found:
        return None
    size = len(found[0][1])
    words = tokens(document, plain)
    words = words if plain else valued(words)
    lines = defaultdict(list)
    for at in range(len(words) - size + 1):
        for i, window in found:
            ours = words[at : at + size]
            if all(map(fits, window, ours)):
                lines[at - i].append((i, window, ours))
    places, steady_places, ats, run = set(), set(), set(), 0
    for hits in lines.values():
        values, where = defaultdict(set), defaultdict(set)
        for i, window, ours in hits:
            for k, (theirs, own) in enumerate(zip(window, ours)):
                if theirs.startswith(MARK) and not plain:
                    values[theirs].add(own)
                    where[theirs].add(i + k)
        repeated = [v for v in values if len(where[v]) > 1]
        unsteady = {v for v in repeated if len(values[v]) > 1 and not v.startswith(D.LOOSE)}
        names = [len(values[v]) == 1 for v in repeated if v.startswith(f"{MARK}p:")]
        left = [i for i, window, _ in hits if not unsteady & set(window)]
        covered = {p for i in left for p in range(i, i + size)}
        places |= covered
        if not names or sum(names) / len(names) >= D.MIN_CONSISTENT:
            steady_places |= covered
        ats |= set(left)
        run = max(run, longest_run(set(left), size) if left else 0)
    n_covered = len({p for i, _ in found for p in range(i, i + size)})
    enough = len(steady_places) >= D.MIN_COVERAGE * n_covered and len(steady_places) >= min(n_tokens, D.MIN_TOKENS)
    if places and (enough or run >= D.MIN_RUN):
        return len(places) / n_covered, not plain, len(found), len(ats)
    return None


def brute(documents, items):
    found = {}
    for d, text in documents:
        for i, item in items:
            ways = [w for plain in (False, True) if text and item and (w := held(text, item, plain))]
            if ways:
                best = max(ways)
                found[d, i] = (best[2], best[3], round(best[0], 9))
    return found


def changed(rng, text):
    """A copy with other numbers, names or words, a part of it, or in another case."""
    words = text.split(" ")
    kind = rng.randrange(7)
    if kind == 0:
        names = {w: rng.choice(["Ida", "Otto", "Eva Maria"]) for w in words if w[:1].isupper()}
        words = [names.get(w, w) for w in words]
    elif kind == 1:
        words = [regex.sub("[0-9]+", lambda m: str(rng.randint(1, 99)), w) for w in words]
    elif kind == 2:
        words = [w if rng.random() > 0.15 else "zzz" for w in words]
    elif kind == 3:
        at = rng.randrange(len(words))
        words = words[at : at + rng.randint(3, 30)]
    elif kind == 4:
        words = text.upper().split(" ")
    elif kind == 5:
        words = [w if rng.random() > 0.05 else rng.choice(["Anna", "7", "5km", "10 %"]) for w in words]
    return " ".join(["some words before", *words, "and After it"])


ITEMS = [
    "Anna buys 12 apples for $3.50 each at the market and then Anna walks 5 km home before dinner with Tom.",
    "The shop opens at nine. The baker sleeps until 9 and sells 40 % of 100 rolls for 2€ each to Eva Braun.",
    "seven blue cats sleep", "one two", "A 5 km run. A 7 km run. A 9 km run by Tom and Tom with 5 km left to go",
]


@pytest.mark.parametrize("broadcast_rows", [0, 2**18])
def test_leaks_equal_the_rules_written_out(spark, tiny, small_documents, broadcast_rows):
    rng = random.Random(11)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect() if r.text][:30]
    items += [(1000 + i, text) for i, text in enumerate(ITEMS)]
    texts = [changed(rng, rng.choice(items)[1]) for _ in range(60)] + [changed(rng, text) for text in ITEMS * 12]
    documents = [(10_000 + i, t) for i, t in enumerate(texts)]
    documents += [(i, t) for i, t in pairs(small_documents) if t and len(t) < 4000][:60]
    table = spark.createDataFrame(documents, "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(table, wanted, broadcast_rows=broadcast_rows).collect()
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, round(r.coverage, 9)) for r in found}
    expected = brute(documents, items)
    assert len(got) == len(found) and len(expected) > 50
    assert got == expected


@pytest.mark.parametrize("broadcast_rows", [0, 2**18])
def test_long_text_full_of_an_item_is_held_in_parts(spark, broadcast_rows):
    """Every window of 60,000 tokens fits; rows that each held the whole text would take 40 GB."""
    text = " ".join([ITEMS[0]] * 3000)
    documents = spark.createDataFrame([(1, text), (2, "nothing of it here at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEMS[0])], "item_id long, text string")
    found = D.find_leaks(documents, items, broadcast_rows=broadcast_rows).collect()
    wanted = held(" ".join([ITEMS[0]] * 3), ITEMS[0], plain=False)
    assert [(r.doc_id, r.item_id, r.coverage, r.n_windows, r.n_matched) for r in found] == [(1, 7, wanted[0], *wanted[2:])]


@pytest.mark.parametrize("broadcast_rows", [0, 2**18])
def test_windows_across_the_border_of_parts(spark, broadcast_rows):
    shifts = [n * D.PART + k for n in (1, 2) for k in range(-24, 3)] + [0, 1, 2]
    item = ITEMS[0]
    documents = [(n, " ".join(["word"] * n + [item])) for n in shifts]
    documents += [(10_000 + n, " ".join(["5 word"] * (n // 2) + [ITEMS[2], "km more"])) for n in shifts if n % 2 == 0]
    items = [(0, item), (1, ITEMS[2])]
    table = spark.createDataFrame(documents, "doc_id long, text string")
    wanted = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(table, wanted, broadcast_rows=broadcast_rows).collect()
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, round(r.coverage, 9)) for r in found}
    assert len(got) == len(found) == len(documents)
    assert got == brute(documents, items)
