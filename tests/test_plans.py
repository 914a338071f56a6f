"""Shapes of physical plans that must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import assembly, metrics, recipes
from millrace.operators.positions import global_position, id_levels
from millrace.plans import views
from millrace.plans.recipe_queries import lengths


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_work_stays_in_the_jvm_without_shuffles(spark, tiny):
    docs = views.recipe_columns(views.table(spark, tiny, "documents"))
    text = plan(recipes.drop_incomplete(recipes.clean_recipes(docs)))
    assert "Exchange" not in text
    assert "Python" not in text


def test_filter_does_not_repeat_the_cleaning(spark, tiny):
    docs = views.recipe_columns(views.table(spark, tiny, "documents"))
    df = recipes.drop_incomplete(recipes.clean_recipes(docs))
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    conditions = [line for line in optimized.splitlines() if "Filter" in line]
    assert conditions and not any("translate" in line for line in conditions)


def test_point_lookup_is_pushed_to_the_scan(spark, tiny):
    from millrace.plans.recipe_queries import get_recipe

    assert "EqualTo(id,100)" in plan(get_recipe(spark, tiny))


def test_only_needed_columns_are_read(spark, tiny):
    text = plan(metrics.long_rows_by_source(lengths(spark, tiny)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["doc_id", "source", "text"] or sorted(
        c.split(":")[0] for c in schema.split(",")
    ) == ["source", "text"]


def single_partition_inputs(text):
    """Operators directly below exchanges into one partition."""
    lines = [re.sub(r"^[\s:+\-*()\d]*", "", line) for line in text.splitlines()]
    return [lines[i + 1] for i, line in enumerate(lines) if line.startswith("Exchange SinglePartition")]


def test_positions_bring_only_totals_into_one_task(spark):
    df = global_position(spark.range(1000), id_levels("id"), [F.col("id")])
    below = single_partition_inputs(plan(df))
    assert below and all("Aggregate" in line for line in below)


def test_packing_brings_only_totals_into_one_task(spark):
    df = spark.range(100).select(
        F.col("id").alias("doc_id"), F.array(F.col("id").cast("int")).alias("input_ids")
    )
    below = single_partition_inputs(plan(assembly.pack_chunks(df)))
    assert below and all("Aggregate" in line for line in below)


def test_samples_are_limited_before_the_shuffle(spark, tiny):
    text = plan(metrics.sample_per_source(views.recipes(spark, tiny), "id"))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["masked_cross_entropy", "filter_logits", "draw_token"])
def test_logit_work_is_shuffled_only_for_totals(spark, tiny, name):
    from millrace.plans.registry import QUERIES
    from millrace.plans import metric_queries  # noqa: F401

    text = plan(QUERIES[name](spark, tiny))
    assert "Window" not in text and "Python" not in text
    assert text.count("Exchange") <= (1 if name == "masked_cross_entropy" else 0)


def test_a_hot_key_beyond_the_bound_is_split(spark):
    from millrace.operators.lookups import lookup

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        # With eight partitions a third of all rows is not far above the median.
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: v for k in settings if (v := spark.conf.get(k, None)) is not None}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        keys = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
        facts = spark.range(0, 200_000, 1, 16).select("id", keys.alias("k"), F.uuid().alias("x"))
        table = spark.range(200_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        joined = lookup(facts, table, ["k"], max_bytes=0).groupBy(F.col("id") % 100).agg(F.sum("v"))
        assert sum(r[1] for r in joined.collect()) == 200_000
        assert "skew=true" in plan(joined)
    finally:
        for key in settings:
            spark.conf.unset(key) if key not in before else spark.conf.set(key, before[key])


def test_length_reports_scan_the_texts_once(spark, tiny):
    df = metrics.length_boxplot(lengths(spark, tiny))
    df.collect()
    text = plan(df)
    assert "ReusedExchange" in text or text.count("FileScan") == 1


def test_nothing_is_cut_on_the_way_to_the_operators(spark, tiny):
    """Chunks and the tail hold all tokens of the corpus, and decoding keeps every word."""
    from millrace.operators import assembly, tokens
    from millrace.plans import views

    ids, vocab, eos = views.encoded_corpus(spark, tiny)
    encoded = {r.doc_id: r.input_ids for r in ids.collect()}
    words = {r.doc_id: r.words for r in tokens.with_words(views.corpus(spark, tiny)).collect()}
    assert {k: len(v) for k, v in encoded.items()} == {k: len(v) + 1 for k, v in words.items()}
    assert {r.doc_id: r.text for r in tokens.decode(ids, vocab).collect()} == {k: " ".join(v) for k, v in words.items()}
    chunks = [r.input_ids for r in assembly.pack_chunks(ids, keep_tail=True).orderBy("chunk_id").collect()]
    stream = [t for k in sorted(encoded) for t in encoded[k]]
    assert chunks[0] + [t for chunk in chunks[1:] for t in chunk[50:]] == stream
    assert views.examples(spark, tiny).count() == views.table(spark, tiny, "documents").count()


def test_batches_are_padded_from_written_rows(spark, tiny):
    """Texts are not tokenised again to find a batch's length."""
    from millrace.plans import corpus_queries

    for query in (corpus_queries.pad_to_batch_max, corpus_queries.bucket_pad, corpus_queries.next_token_pairs):
        shown = query(spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in shown and "ArrowEvalPython" not in shown


def test_merged_feeds_are_numbered_from_one_merge(spark, tiny):
    from millrace.plans import recipe_queries

    shown = recipe_queries.assign_ids(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in shown
