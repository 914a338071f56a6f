import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import metrics


def words(text):
    return re.findall(r"\w+", text.lower())


def bleu(references, hypothesis):
    """Sentence BLEU-4 with 0.1 for no match."""
    shares = []
    for n in range(1, 5):
        def grams(w, n=n):
            return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

        mine, best = grams(hypothesis), Counter()
        for reference in references:
            best |= grams(reference)
        hits = sum(min(c, best[g]) for g, c in mine.items())
        if n == 1 and hits == 0:
            return 0.0
        shares.append((hits or 0.1) / max(1, sum(mine.values())))
    size = len(hypothesis)
    closest = min((abs(len(r) - size), len(r)) for r in references)[1]
    brevity = 1.0 if size > closest else math.exp(1 - closest / size)
    return brevity * math.exp(sum(map(math.log, shares)) / 4)


def mean_bleu(texts):
    if len(texts) < 2:
        return 0.0
    split = [words(t) for t in texts]
    return sum(bleu(split[:i] + split[i + 1 :], w) for i, w in enumerate(split)) / len(texts)


def self_bleu(spark, groups):
    rows = [(g, i, t) for g, texts in groups.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, id long, text string").repartition(4)
    return {r.g: r.self_bleu for r in metrics.self_bleu(df, ["g"]).collect()}


def test_self_bleu_of_null_texts_and_repeated_ids(spark):
    rows = [("g", 1, "a b c d e"), ("g", 1, "a b c d e"), ("h", 1, "a b c d e"), ("h", 2, None)]
    df = spark.createDataFrame(rows, "g string, id int, text string")
    got = {r.g: (r.texts, r.self_bleu) for r in metrics.self_bleu(df, ["g"]).collect()}
    assert got["g"] == (2, pytest.approx(1.0)) and got["h"] == (2, 0.0)


def test_self_bleu_known_values(spark):
    got = self_bleu(
        spark,
        {
            "same": ["the cat sat on the mat"] * 2,
            "cook": ["grill the chicken now", "boil the rice"],
            "apart": ["a b", "c d"],
            "one": ["a b c d"],
            "empty": ["", "a b"],
        },
    )
    assert got["same"] == pytest.approx(1.0)
    assert got["cook"] == pytest.approx(0.080878, abs=1e-6)
    assert got["apart"] == got["one"] == got["empty"] == 0.0


def test_self_bleu_against_brute_force(spark):
    rng = random.Random(2)
    groups = {
        f"g{k}": [" ".join(rng.choices("abcdefg", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        for k in range(40)
    }
    # One group holds a third of all texts, many of them copies.
    groups["hot"] = ["a b c d e", "a b c d f"] * 40 + ["a a a a a a"]
    got = self_bleu(spark, groups)
    for name, texts in groups.items():
        assert got[name] == pytest.approx(mean_bleu(texts), abs=1e-9), name


def test_diversity(spark):
    df = spark.createDataFrame(
        [("The the the the",), ("a b c a b c",), ("a b",), ("",)], "t string"
    )
    assert [r[0] for r in df.select(metrics.text_diversity(F.col("t"))).collect()] == [0.5, 0.75, 0.0, 0.0]


@pytest.mark.parametrize(
    "bounds", [{}, {"worker_bytes": 0}, {"worker_bytes": 0, "max_bytes": 0}]
)
def test_lexical_validity(spark, bounds):
    df = spark.createDataFrame([(1, "The cat, the DOG"), (2, ""), (3, "xx"), (4, None)], "id long, text string")
    known = spark.createDataFrame([("the",), ("cat",), ("the",)], "word string")
    got = {r.id: r.lexical_validity for r in metrics.lexical_validity(df, known, ["id"], **bounds).collect()}
    assert got == {1: 0.75, 2: 0.0, 3: 0.0, 4: 0.0}


def test_cross_entropy_against_numpy(spark):
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(50, 9)).astype("float32")
    labels = [int(x) if i % 7 else -100 for i, x in enumerate(rng.integers(0, 9, 50))]
    df = spark.createDataFrame(
        [(x.tolist(), y) for x, y in zip(logits, labels)], "logits array<float>, label int"
    )
    got = metrics.masked_cross_entropy(df).first()
    wide = logits.astype("float64")
    losses = [np.log(np.exp(x).sum()) - x[y] for x, y in zip(wide, labels) if y != -100]
    assert got.loss_sum == pytest.approx(sum(losses), abs=1e-9)
    assert got.correct == sum(int(x.argmax() == y) for x, y in zip(wide, labels))
    assert got.total == len(losses)


def test_large_logits_do_not_overflow(spark):
    df = spark.createDataFrame([([5000.0, 4999.0], 1)], "logits array<float>, label int")
    assert metrics.masked_cross_entropy(df).first().loss_sum == pytest.approx(math.log(1 + math.e))


def test_empty_and_capped_summaries(spark):
    df = spark.createDataFrame(
        [(0.0, 0, 0), (900.0, 1, 10)], "loss_sum double, correct long, total long"
    )
    rows = sorted(tuple(r)[3:] for r in metrics.loss_summary(df).collect())
    assert rows == [(0.0, 0.0, 1.0), (90.0, 0.1, pytest.approx(math.exp(20)))]


def test_windows(spark):
    df = spark.range(41).select(
        F.col("id").alias("step"), F.lit(2.0).alias("loss_sum"),
        F.lit(1).cast("long").alias("correct"), F.lit(4).cast("long").alias("total"),
    )
    got = sorted((r.step, r.total, r.loss, r.accuracy) for r in metrics.accumulate_windows(df, 16).collect())
    assert got == [(16, 64, 0.5, 0.25), (32, 64, 0.5, 0.25)]
    assert metrics.evaluate_first(df, 10).first().total == 40
    assert metrics.evaluate_first(df).first().total == 164


def test_evaluation_of_nothing_is_not_a_number(spark):
    df = spark.createDataFrame([], "step long, loss_sum double, correct long, total long")
    assert math.isnan(metrics.evaluate_first(df).first().loss)


def box(values):
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = [v for v in values if low <= v <= high]
    return q1, q2, q3, min(inside), max(inside), len(values) - len(inside)


def test_length_reports_against_numpy(spark):
    rng = random.Random(9)
    values = [int(rng.lognormvariate(5, 1)) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values], "length int").repartition(4)
    got = metrics.length_profile(df).first()
    assert tuple(got) == (
        3001, pytest.approx(np.mean(values)), np.median(values), sum(v > 512 for v in values)
    )
    assert tuple(metrics.length_boxplot(df).first()) == box(values)
    counts, _ = np.histogram(values, bins=50)
    bins = {r.bin: r.n for r in metrics.length_histogram(df).collect()}
    assert [bins[i] for i in range(50)] == counts.tolist()


def test_histogram_of_one_length(spark):
    df = spark.createDataFrame([(7,)] * 3, "length int")
    counts, _ = np.histogram([7] * 3, bins=50)
    bins = {r.bin: r.n for r in metrics.length_histogram(df).collect()}
    assert [bins[i] for i in range(50)] == counts.tolist()


def test_long_rows_and_samples(spark):
    df = spark.range(300).select(
        "id", F.when(F.col("id") < 295, "big").otherwise("small").alias("source"),
        (F.col("id") * 2).alias("length"),
    )
    assert {r.source: r.too_long for r in metrics.long_rows_by_source(df).collect()} == {
        "big": 294 - 256, "small": 5,
    }
    assert metrics.long_rows_by_source(df, 10**6).where("too_long = 0").count() == 2
    sizes = {r.source: r["count"] for r in metrics.sample_per_source(df, "id").groupBy("source").count().collect()}
    assert sizes == {"big": 10, "small": 5}


def test_learning_rate(spark):
    steps = {0: 0, 150: 0.5, 300: 1, 1650: 0.5, 2448: 0.1, 3000: 0.1, 5700: 1}
    df = spark.createDataFrame([(s,) for s in steps], "step long")
    got = df.select("step", metrics.lr_schedule(F.col("step"), 300, 300, 2700).alias("m")).collect()
    assert {r.step: r.m for r in got} == {s: pytest.approx(m, abs=1e-3) for s, m in steps.items()}


def test_self_bleu_counts_a_bounded_share_of_the_words_at_once(spark):
    rng = random.Random(4)
    texts = [(i % 2, i, " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(texts, "g int, id int, text string")
    whole = metrics.self_bleu(df, ["g"])
    parts = metrics.self_bleu(df, ["g"], task_words=5)
    known = {r.g: (r.texts, r.self_bleu) for r in whole.collect()}
    assert {r.g: (r.texts, pytest.approx(r.self_bleu)) for r in parts.collect()} == known
    # The holder of a gram is found by hashing; grams are never sorted.
    plan = parts._jdf.queryExecution().executedPlan().toString()
    words = sum(len(text.split()) for _, _, text in texts)
    assert f"{-(-words // 5)}), REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan
