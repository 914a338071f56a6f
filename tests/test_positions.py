import random

from pyspark.sql import functions as F

from millrace.operators.lookups import lookup
from millrace.operators.positions import (
    global_position,
    hash_levels,
    id_levels,
    running_total,
    seeded_hash,
)


def test_positions_follow_the_order(spark):
    rng = random.Random(3)
    ids = rng.sample(range(-(10**7), 10**12), 500)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r.id: r.position for r in global_position(df, id_levels("id"), [F.col("id")]).collect()}
    assert got == {i: p for p, i in enumerate(sorted(ids), 1)}


def test_hash_order_is_a_sort_by_hash(spark):
    df = spark.range(1000).withColumn("h", seeded_hash("id"))
    placed = global_position(df, hash_levels("h"), [F.col("h"), F.col("id")]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == [
        r.id for r in sorted(placed, key=lambda r: (r.h, r.id))
    ]


def test_text_order(spark):
    words = ["b", "a", "abcdefgh", "abcdefga", "abcdef", "ä", "zz", "", "漢字"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    placed = global_position(df, [F.substring("w", 1, 2), F.substring("w", 1, 6)], [F.col("w")]).collect()
    by_bytes = sorted(words, key=lambda w: w.encode())
    assert [r.w for r in sorted(placed, key=lambda r: r.position)] == by_bytes


def test_running_totals_per_group(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randint(0, 9)) for g in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i long, v int").repartition(5)
    got = running_total(df, F.col("v"), id_levels("i"), [F.col("i")], "before", ["g"])
    expected, sums = {}, {}
    for g, i, v in rows:
        expected[g, i] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    assert {(r.g, r.i): r.before for r in got.collect()} == expected


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "id long")
    placed = global_position(df, id_levels("id"), [F.col("id")]).collect()
    assert sorted((r.position, r.id) for r in placed) == [(1, None), (2, 1), (3, 2)]


def test_lookup_paths_agree(spark):
    facts = spark.range(2000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k")
    )
    table = spark.createDataFrame([("hot", 1), ("5", 2), ("none", 3)], "k string, v int")
    near = lookup(facts, table, ["k"])
    split = lookup(facts, table, ["k"], hot=F.col("v") == 1, max_bytes=30)
    plain = lookup(facts, table, ["k"], max_bytes=0)
    for far in (split, plain):
        assert sorted(near.collect()) == sorted(far.select(*near.columns).collect())


def test_a_null_key_stays_without_a_match(spark):
    facts = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, k string")
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    got = lookup(facts, table, ["k"], hot=F.col("v") == 1, max_bytes=20)
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, None), (2, 1), (3, 2)]


def test_hash_like_ids(spark):
    rng = random.Random(4)
    ids = [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    placed = global_position(df, id_levels("id"), [F.col("id")]).collect()
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == sorted(ids)
