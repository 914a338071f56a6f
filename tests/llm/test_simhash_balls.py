import random

import pytest
import xxhash

from millrace.llm import simhash_balls

from .conftest import order, pairs, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius):
    """The smallest place that each value's component reaches, by comparing all pairs."""
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                i_root, j_root = root(i), root(j)
                parent[max(i_root, j_root)] = min(i_root, j_root)
    return [root(i) for i in range(len(values))]


def brute(rows):
    rows = sorted(rows, key=lambda r: order(r[0]))
    prints = [fingerprint(t) for _, t in rows]
    return sorted((order(i), f"{p:016x}", order(rows[c][0])) for (i, _), p, c in zip(rows, prints, classes(prints, 2)))


def found(df):
    rows = simhash_balls.simhash_components(df).collect()
    return sorted((order(r.doc_id), r.fingerprint, order(r.component_id)) for r in rows)


def test_odd_rows_equal_brute_force(odd_rows):
    assert found(odd_rows) == brute(pairs(odd_rows))


def test_given_documents_equal_brute_force(small_documents):
    assert found(small_documents) == brute(pairs(small_documents))


def test_near_copies_equal_brute_force(spark):
    random.seed(5)
    texts = []
    for _ in range(12):
        base = ["w%d" % random.randint(0, 300) for _ in range(random.choice([3, 40, 400, 900]))]
        texts.append(" ".join(base))
        for _ in range(6):
            base[random.randrange(len(base))] = "changed"
            texts.append("  ".join(base).upper())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = found(df)
    assert got == brute(pairs(df))
    assert len({c for _, _, c in got}) < len({p for _, p, _ in got})


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, radius):
    random.seed(radius)
    values = [0, 2**64 - 1]
    for _ in range(60):  # chains whose steps are on both sides of the radius
        value = random.getrandbits(64)
        for _ in range(random.randint(1, 6)):
            values.append(value)
            for bit in random.sample(range(64), random.randint(1, 4)):
                value ^= 1 << bit
    centre = random.getrandbits(64)
    values = sorted(set(values + [centre ^ (1 << b) for b in range(64)]))
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "print long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash_balls.links(df, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [root(v) for v in values] == [values[c] for c in classes(values, radius)]
    assert len(edges) <= len(values) * 64  # a ball of 64 values is no clique of edges


def test_empty_table_and_keep_one(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert found(none) == []
    rows = [(3, "a b c d"), (1, "A  b c D"), (2, None), (5, ""), (7, "x y z"), (None, "x Y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in simhash_balls.keep_one(df).collect()} == {1, 2, None}
