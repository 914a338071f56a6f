import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, positives=5, negatives=10):
    """By comparing everything in Python's integers."""
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in rows]
    order = lambda s, i: (-s, -(2**63) if i is None else i)
    found = []
    for a, (anchor, _, label) in enumerate(rows):
        if not anchors(anchor):
            continue
        scores = [(sum(x * y for x, y in zip(whole[a], v)), rows[k][0], rows[k][2]) for k, v in enumerate(whole) if k != a]
        near = sorted([(s, i) for s, i, lab in scores if lab == label], key=lambda x: order(*x))[:positives]
        for p, positive in near:
            far = [(s, i) for s, i, lab in scores if lab != label and 30 * p <= 100 * s <= 90 * p]
            for rank, (s, i) in enumerate(sorted(far, key=lambda x: order(*x))[:negatives], 1):
                found.append((anchor, positive, rank, i, p, s))
    return sorted(found, key=str)


def found(df, **options):
    rows = hn.mine_negatives(df, F.col("vec_id") % 10 == 0, **options).collect()
    return sorted((tuple(r) for r in rows), key=str)


def anchors(i):
    return i is not None and i % 10 == 0


@pytest.mark.parametrize("width, blocks", [(64, 1000), (70, 3), (3, 1000)])
def test_random_vectors_equal_brute_force(spark, width, blocks):
    rng = np.random.default_rng(width)
    vectors = rng.standard_normal((300, width)) * rng.choice([0.01, 0.1, 1], (300, 1))
    rows = [(i, [float(np.float32(x)) for x in v], int(rng.integers(4))) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, block_anchors=blocks) == brute(rows, anchors)


def test_odd_rows_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    some = [float(np.float32(x)) for x in rng.standard_normal(8)]
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)], i % 3) for i in range(60)]
    rows += [(100 + i, some, i % 2) for i in range(40)]  # ties
    rows += [(20, some, 1), (20, some, 1), (None, some, 1), (None, some, 0), (30, [], 1), (40, some[:3], 1), (50, [0.0] * 8, 2)]
    rows += [(60, None, 1), (70, some, None), (80, [1.0, None], 1), (80, [float("nan")], 1), (80, [float("inf")], 1), (91, [-1e30], 1)]
    rows += [(-10, some, 1), (110, [-x for x in some], 0)]
    bounded = [(i, v and [max(min(x, hn.limit(8) / 256), -hn.limit(8) / 256) if x is not None and math.isfinite(x) else x for x in v], k) for i, v, k in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "number", "anchor", "vector", "score", "slot", "rank"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    big = lambda r: r[1] and any(x and abs(x) > 1e9 for x in r[1])
    got = found(df)
    assert [r for r in got if 91 not in (r[1], r[3])] == [r for r in brute(bounded, anchors) if 91 not in (r[1], r[3])]
    assert found(df.where("vec_id is null or vec_id <> 91")) == brute([r for r in rows if not big(r)], anchors)


def test_tables_without_results(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(10, [], 1), (20, [], 2)], SCHEMA)) == []
    assert found(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], SCHEMA)) == []


@pytest.mark.parametrize("planes, least", [(1, 0.0), (4, 0.5)])
def test_intervals_hold_the_scores_and_discard_rows(monkeypatch, planes, least):
    monkeypatch.setattr(hn, "PLANES", planes)
    rng = np.random.default_rng(7)
    whole = np.floor(256 * (v := rng.standard_normal((2000, 64))) / np.linalg.norm(v, axis=1, keepdims=True))
    whole[0], whole[1] = 0, 1
    rotated = whole @ hn.rotation(64)
    coded, fine = hn.code_planes(rotated, planes), hn.code_planes(rotated, hn.ANCHOR_PLANES)
    table = pa.table({
        "number": np.arange(2000), "id": np.arange(2000), "label": np.zeros(2000, np.int64),
        "whole": hn.binaries(whole.astype(np.int32)), "planes": hn.binaries(coded[0]), "align": coded[1], "rest": coded[2],
        "fine": hn.binaries(fine[0]), "fine_align": fine[1], "fine_rest": fine[2],
    })
    left, right = hn.Codes.of(table.slice(0, 50), 64, fine=True), hn.Codes.of(table, 64)
    lower, upper = hn.intervals(left, right, 64)
    scores = whole[:50] @ whole.T
    assert (lower <= scores).all() and (scores <= upper).all()
    tenth = np.sort(scores, axis=1)[:, -10:][:, :1]
    assert (upper < tenth).mean() >= least
