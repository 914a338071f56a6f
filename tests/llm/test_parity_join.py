import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import parity_join
from millrace.llm.spans import slices

from .conftest import order, pairs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets, ids = [shingles(t) for _, t in rows], [order(i) for i, _ in rows]
    holders = defaultdict(list)
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in enumerate(sets):
        common = Counter(j for s in own for j in holders[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                parent[root(k)] = root(j)
        for s in own:
            holders[s].append(k)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, i in enumerate(ids))


def found(df):
    rows = parity_join.jaccard_components(df).collect()
    return sorted((order(r.doc_id), r.n_shingles, order(r.component_id)) for r in rows)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def near_copies(seed):
    random.seed(seed)
    texts = []
    for _ in range(30):
        n = random.choice([1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 60, 150])
        base = ["w%d" % random.randint(0, 400) for _ in range(n)]
        texts.append(" ".join(base))
        for copy in range(random.randint(0, 6)):
            changed = base[:]
            for _ in range(random.randint(0, max(1, n // 25))):
                changed[random.randrange(n)] = "z%d" % random.randint(0, 9)
            texts.append(" ".join(changed).upper() if copy == 2 else " ".join(changed))
    return texts


def test_near_copies_equal_brute_force(spark):
    df = frame(spark, near_copies(3))
    assert found(df) == brute(pairs(df))


@pytest.fixture(scope="module")
def chain(spark):
    """A chain of near copies, linked only step by step, and a line that all others share."""
    random.seed(4)
    base, texts = ["w%d" % i for i in range(200)], []
    for i in range(120):
        changed = base[:]
        for j in range(i):
            changed[(j * 7) % 200] = "e%d" % j
        texts.append(" ".join(changed))
    line = "the very common line that all of these documents share with every other one"
    texts += [line + " " + " ".join("r%d_%d" % (i, j) for j in range(i % 20)) for i in range(200)]
    return frame(spark, texts)


def test_a_chain_and_a_hot_line(chain):
    assert found(chain) == brute(pairs(chain))


@pytest.mark.parametrize("most, block", [(3, 2048), (0, 7)])
def test_many_strays_are_compared_in_blocks(chain, monkeypatch, most, block):
    monkeypatch.setattr(parity_join, "MOST_STRAYS", most)
    monkeypatch.setattr(parity_join, "BLOCK", block)
    assert found(chain) == brute(pairs(chain))


def test_odd_rows(odd_rows):
    assert found(odd_rows) == brute(pairs(odd_rows))


def test_given_documents(small_documents):
    assert found(small_documents) == brute(pairs(small_documents))


def test_no_documents(odd_rows):
    assert found(odd_rows.limit(0)) == []


def test_rows_that_share_an_id_have_texts_of_their_own(spark):
    random.seed(6)
    rows = []
    for i in range(40):
        one, two = ([f"w{random.randint(0, 500)}" for _ in range(30)] for _ in range(2))
        near = [*one[:-1], "changed"]
        rows += [(i, " ".join(x)) for x in random.sample([one, two], 2)] + [(1000 + i, " ".join(near))]
    rows += [(7, rows[0][1])] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(pairs(df))


def test_sets_that_share_a_hash_are_told_apart(small_documents):
    """With a first hash of three bits, only the second one tells sets apart."""
    rows = small_documents.selectExpr("doc_id", "doc_id AS id", "text")
    sets = parity_join.set_table(rows, 5)
    apart, clashing = parity_join.told_apart(sets.withColumn("node", sets["node"].bitwiseAND(7)))
    assert sorted(clashing.tolist()) == list(range(8))
    assert apart.select("node").distinct().count() == sets.select("check").distinct().count()
    batch = pa.record_batch({"text": pa.array(["one two three four five", "x", "six seven eight nine ten"])})
    own = parity_join.Shingles(next(slices(batch)), 5)
    plain, moved = own.nodes(), own.nodes(own.nodes()[1:2])
    assert (plain == moved).tolist() == [True, False, True]
    assert moved[1] == parity_join.mix(plain[1:2] ^ parity_join.mix(own.checks()[1:2]))[0]


def test_one_document_of_each_group_stays(spark):
    df = frame(spark, ["a b c d e f", "A b c d e f", None, "", "q r s t u v"])
    assert sorted(r.doc_id for r in parity_join.keep_one(df).collect()) == [0, 2, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10**6))
def test_sets_at_the_threshold_share_a_key(n, seed):
    """Random pairs with a similarity of exactly or just over the threshold."""
    random.seed(seed)
    tokens = ["t%d" % i for i in range(n)]
    union_extra = random.randint(0, n)
    drop = max(d for d in range(n + 1) if 100 * (n - d) >= 80 * (n + min(union_extra, max(0, (100 * (n - d)) // 80 - n))))
    add = max(0, (100 * (n - drop)) // 80 - n)
    one, two = tokens, tokens[drop:] + ["u%d" % i for i in range(add)]
    keys = []
    for words_ in (one, two):
        # Lines of single words: a shingle of size 1 is a word, so sets are what they seem.
        batch = pa.record_batch({"text": pa.array([" ".join(words_)])})
        sets = parity_join.Shingles(next(slices(batch)), 1)
        assert sets.count.tolist() == [len(words_)]
        keys.append((set(parity_join.sketch_keys(sets, np.ones(1, bool))[0].tolist()), sets.nodes()[0]))
    assert keys[0][1] == keys[1][1] or keys[0][0] & keys[1][0]


def test_bit_sketches_bound_the_difference():
    random.seed(9)
    for _ in range(40):
        n, m = random.randint(1, 300), random.randint(1, 300)
        lists = [["a%d" % i for i in range(n)], ["a%d" % i for i in range(m)] + ["b%d" % i for i in range(random.randint(0, 50))]]
        batch = pa.record_batch({"text": pa.array([" ".join(x) for x in lists])})
        sketches = parity_join.bit_sketches(parity_join.Shingles(next(slices(batch)), 1))
        assert parity_join.hamming(sketches[:1], sketches[1:])[0] <= len(set(lists[0]) ^ set(lists[1]))
