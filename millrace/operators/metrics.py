"""Loss, diversity, self-BLEU, lexical validity and length reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.logits import row_loss
from millrace.functions.tables import WORKER_TABLE_BYTES, positions_in
from millrace.functions.text import word_tokens
from millrace.functions.tokens import IGNORE_INDEX, ngram_diversity, ngrams
from millrace.operators.lookups import fits_broadcast, lookup
from millrace.operators.once import compute_once
from millrace.operators.positions import seeded_hash
from millrace.sources.scratch import cut_lineage


def masked_cross_entropy(
    df: DataFrame, logits: str = "logits", label: str = "label", by: list[str] | None = None
) -> DataFrame:
    """Sums of loss, hits and counted rows; rows labelled -100 add nothing."""
    loss, hit = row_loss(F.col(logits), F.col(label))
    rows = df.withColumns({"_loss": loss, "_hit": hit, "_counted": F.col(label) != IGNORE_INDEX})
    return rows.groupBy(*(by or [])).agg(
        F.coalesce(F.sum("_loss"), F.lit(0.0)).alias("loss_sum"),
        F.count_if("_hit").alias("correct"),
        F.count_if("_counted").alias("total"),
    )


def loss_summary(sums: DataFrame, empty: float = 0.0) -> DataFrame:
    """Loss, accuracy and perplexity from sums; ``empty`` stands for 0/0."""
    loss = F.coalesce(F.try_divide("loss_sum", "total"), F.lit(empty))
    accuracy = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("total")), F.lit(empty))
    return sums.withColumns({"loss": loss, "accuracy": accuracy}).withColumn(
        "perplexity", F.exp(F.least(F.col("loss"), F.lit(20.0)))
    )


def accumulate_windows(df: DataFrame, n: int) -> DataFrame:
    """One summary row per finished window of ``n`` steps, at the step after it."""
    window = F.floor(F.col("step") / n).alias("_window")
    sums = df.groupBy(window).agg(
        F.sum("loss_sum").alias("loss_sum"),
        F.sum("correct").alias("correct"),
        F.sum("total").alias("total"),
        F.max("step").alias("_last"),
    )
    done = sums.where(F.pmod("_last", F.lit(n)) == n - 1)
    rows = done.select((F.col("_last") + 1).alias("step"), "loss_sum", "correct", "total")
    return loss_summary(rows)


def evaluate_first(df: DataFrame, max_steps: int | None = None, batch: str = "step") -> DataFrame:
    """Summary over the first ``max_steps`` batches of the fixed order, or over all."""
    rows = df if not max_steps else df.where(F.col(batch) < max_steps)
    sums = rows.agg(
        F.sum("loss_sum").alias("loss_sum"),
        F.sum("correct").alias("correct"),
        F.sum("total").alias("total"),
    )
    return loss_summary(sums, float("nan"))


def text_diversity(text: Column, n: int = 3) -> Column:
    return ngram_diversity(word_tokens(text), n)


#: Words whose grams one task of ``self_bleu`` counts, about.
TASK_WORDS = 2**17


def self_bleu(
    df: DataFrame, group: list[str], id: str = "id", text: str = "text", max_n: int = 4, task_words: int = TASK_WORDS
) -> DataFrame:
    """Mean BLEU of each text against the others of its group, with smoothing.

    An occurrence of a gram, numbered within its text, is a clipped hit if another
    text has that gram as often.  So hits are the gram total less the occurrences
    held by one text only: one aggregation, and texts are never joined or paired.

    A NULL text counts as an empty one.  Rows of a group may share an ``id``, which is not
    read: the words are written once, with a row number of their own.
    """
    words = F.col("_words")
    # One number, so that the greatest holder of a gram is found by hashing, without a sort.
    texts = df.select(
        *group,
        F.monotonically_increasing_id().alias("_id"),
        word_tokens(F.coalesce(text, F.lit(""))).alias("_words"),
    )
    texts = cut_lineage(texts.withColumn("_size", F.size(words)), "bleu-words")

    # Words travel once, by text, so that the longer grams are counted in place: a task's
    # share is told by the words, which are far fewer than the grams that it holds at once.
    total = texts.agg(F.sum("_size")).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // task_words))
    grams = (
        texts.repartition(parts, *group, "_id")
        .select(*group, "_id", F.posexplode(F.array(*[ngrams(words, n + 1) for n in range(max_n)])))
        .select(*group, "_id", (F.col("pos") + 1).alias("n"), F.explode("col").alias("gram"))
    )
    counts = grams.groupBy(*group, "_id", "n", "gram").agg(F.count(F.lit(1)).alias("c"))
    occurrences = counts.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    held = occurrences.groupBy(*group, "n", "gram", "k").agg(
        F.count(F.lit(1)).alias("holders"), F.max("_id").alias("_id")
    )
    misses = (
        held.where("holders = 1")
        .groupBy(*group, "_id")
        .agg(*[F.count_if(F.col("n") == n).alias(f"_missed{n}") for n in range(1, max_n + 1)])
    )

    # Closest other length, from the few distinct lengths of each group.
    lengths = texts.groupBy(*group, "_size").agg(F.count(F.lit(1)).alias("_same"))
    order = Window.partitionBy(*group).orderBy("_size")
    below, above = F.lag("_size").over(order), F.lead("_size").over(order)
    size = F.col("_size")
    closest = (
        F.when(F.col("_same") > 1, size)
        .when(above.isNull() | (size - below <= above - size), below)
        .otherwise(above)
    )
    lengths = lengths.select(*group, "_size", closest.alias("_reference"))

    scored = texts.drop("_words").join(misses, [*group, "_id"], "left")
    # Copies of one text share their length: a table lookup, not a skewed join.
    scored = lookup(scored, cut_lineage(lengths, "text-lengths"), [*group, "_size"])
    logs, hits = F.lit(0.0), None
    for n in range(1, max_n + 1):
        total = F.greatest(F.col("_size") - (n - 1), F.lit(0))
        matched = total - F.coalesce(F.col(f"_missed{n}"), F.lit(0))
        hits = matched if n == 1 else hits
        # Fixed value of the smoothing rule: 0.1 for no match.
        share = F.when(matched == 0, 0.1).otherwise(matched) / F.greatest(total, F.lit(1))
        logs = logs + F.ln(share) / max_n
    brevity = F.when(size > F.col("_reference"), 1.0).otherwise(
        F.exp(1 - F.try_divide(F.col("_reference"), size))
    )
    bleu = F.when((size == 0) | (hits == 0), 0.0).otherwise(brevity * F.exp(logs))
    return (
        scored.withColumn("_bleu", bleu)
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("texts"), F.avg("_bleu").alias("self_bleu"))
        .withColumn("self_bleu", F.when(F.col("texts") < 2, 0.0).otherwise(F.col("self_bleu")))
    )


def lexical_validity(
    df: DataFrame,
    dictionary: DataFrame,
    key: list[str],
    text: str = "text",
    worker_bytes: int = WORKER_TABLE_BYTES,
    **bounds: int,
) -> DataFrame:
    """Share of each row's words found in ``dictionary(word)``, 0.0 without words.

    A dictionary measured within ``worker_bytes`` goes to the workers; a larger
    one meets the exploded words in a join.
    """
    words = word_tokens(F.col(text))
    if fits_broadcast(dictionary, worker_bytes):
        counted = compute_once(
            df.select(*key, text), {"_found": positions_in(dictionary, "word")(words)}
        )
        valid = F.size(F.array_compact("_found"))
        share = F.when(F.size("_found") == 0, 0.0).otherwise(
            valid / F.greatest(F.size("_found"), F.lit(1))
        )
        return counted.select(*key, share.alias("lexical_validity"))
    places = df.select(*key, F.explode_outer(words).alias("word"))
    known = dictionary.select("word").distinct().withColumn("known", F.lit(True))
    found = lookup(places, known, ["word"], **bounds)
    total, valid = F.count("word"), F.count_if("known")
    return found.groupBy(*key).agg(
        F.when(total == 0, 0.0).otherwise(F.try_divide(valid, total)).alias("lexical_validity")
    )


def checkpoint_summary(
    generations: DataFrame,
    samples: DataFrame,
    dictionary: DataFrame,
    key: list[str] | None = None,
    sample_id: str = "sample",
) -> DataFrame:
    """Per step: mean diversity and validity of the outputs, self-BLEU of the samples."""
    key = key or ["step", "prompt_id"]
    scored = generations.select(*key, text_diversity(F.col("output")).alias("diversity")).join(
        lexical_validity(generations, dictionary, key, "output"), key
    )
    means = scored.groupBy("step").agg(
        F.avg("diversity").alias("avg_diversity"),
        F.avg("lexical_validity").alias("avg_lexical_validity"),
    )
    bleu = self_bleu(samples, ["step"], sample_id, "output").select("step", "self_bleu")
    return means.join(bleu, "step", "left").withColumn(
        "self_bleu", F.coalesce("self_bleu", F.lit(0.0))
    )


def length_counts(df: DataFrame, length: str = "length") -> DataFrame:
    """Rows per length: the small table behind every length report."""
    return df.groupBy(F.col(length).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def length_profile(df: DataFrame, limit: int = 512) -> DataFrame:
    """Count, mean, median and number above ``limit`` of a length column."""
    return length_counts(df).agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean_length"),
        F.percentile("length", 0.5, F.col("n")).alias("median_length"),
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n"))), F.lit(0)).alias("too_long"),
    )


def length_boxplot(df: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the last points within 1.5 IQR, and outlier count."""
    counts = length_counts(df)
    quarters = counts.agg(F.percentile("length", [0.25, 0.5, 0.75], F.col("n")).alias("q")).scalar()
    q1, q2, q3 = (F.get("q", F.lit(i)) for i in range(3))
    reach = 1.5 * (q3 - q1)
    inside = (F.col("length") >= q1 - reach) & (F.col("length") <= q3 + reach)
    return (
        counts.withColumn("q", quarters)
        .select("*", q1.alias("q1"), q2.alias("median"), q3.alias("q3"), inside.alias("inside"))
        .groupBy("q1", "median", "q3")
        .agg(
            F.min(F.when(F.col("inside"), F.col("length"))).alias("whisker_low"),
            F.max(F.when(F.col("inside"), F.col("length"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("outliers"),
        )
    )


def length_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Rows in equal-width bins from the least to the greatest length.

    The last bin is closed on the right; empty bins are listed.
    """
    counts = length_counts(df)
    edges = counts.agg(F.struct(F.min("length").alias("low"), F.max("length").alias("high"))).scalar()
    low, high = F.col("edges.low"), F.col("edges.high")
    # One single length sits in the middle of a range one wide.
    place = F.when(low == high, F.lit(bins // 2)).otherwise(
        F.floor((F.col("length") - low) * bins / F.greatest(high - low, F.lit(1)))
    )
    filled = (
        counts.withColumn("edges", edges)
        .groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def long_rows_by_source(df: DataFrame, limit: int = 512) -> DataFrame:
    """Over-long rows of every source, sources without any included."""
    return df.groupBy("source").agg(F.count_if(F.col("length") > limit).alias("too_long"))


def sample_per_source(df: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """``n`` random rows of each source, or all of them.

    The limit on the row number runs in every map task before the shuffle, so a
    large source sends at most ``n`` rows per task.
    """
    order = Window.partitionBy("source").orderBy("_hash", key)
    ranked = df.withColumn("_hash", seeded_hash(key, seed)).withColumn(
        "sample_rank", F.row_number().over(order)
    )
    return ranked.where(F.col("sample_rank") <= n).drop("_hash")


def lr_schedule(
    step: Column, warmup: int, decay_start: int, decay_total: int, floor: float = 0.1
) -> Column:
    """Learning-rate multiplier: linear warm-up, flat, cosine decay with a floor."""
    cosine = 0.5 * (1 + F.cos(F.lit(math.pi) * (step - decay_start) / decay_total))
    decayed = F.greatest(F.lit(floor), cosine)
    ramp = step / F.lit(warmup) if warmup else F.lit(1.0)
    return (
        F.when(step < warmup, ramp).when(step >= decay_start, decayed).otherwise(F.lit(1.0))
    )
