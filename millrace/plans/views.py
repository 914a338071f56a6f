"""The given tables seen as recipes, corpora, logits, logs and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tokens import append_eos, ones_like
from millrace.operators.recipes import finetune_text, load_recipes
from millrace.operators.tokens import (
    build_vocab,
    encode,
    special_ids,
    with_words,
)
from millrace.sources.scratch import cut_lineage
from millrace.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a text table, spread over the cores if it is small."""
    return spread(table(spark, sf_dir, name).select(*columns), f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents", "doc_id", "text")


def recipe_columns(documents: DataFrame) -> DataFrame:
    return documents.select(
        (F.col("doc_id") + 1).alias("id"),
        "source",
        F.regexp_extract("text", r"^[^\n.]*", 0).alias("title"),
        F.split("text", "\n").alias("ingredients"),
        F.col("text").alias("instructions"),
    )


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe_columns(texts(spark, sf_dir, "documents", "doc_id", "source", "text"))


def feeds(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three feeds ``(source, ordinal, key, recipe)`` with colliding keys."""
    docs = recipes(spark, sf_dir).withColumn("doc_id", F.col("id") - 1)
    entries = docs.select(
        F.col("doc_id").alias("ordinal"),
        F.floor(F.col("doc_id") / 4).cast("string").alias("key"),
        F.struct("title", "ingredients", "instructions").alias("recipe"),
    )
    return [
        entries.where(F.col("ordinal") % 3 == rank) for rank in range(3)
    ]


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine-tune examples ``(ex_id, text, words, length)``, of any length."""
    rendered = with_words(finetune_text(load_recipes(recipes(spark, sf_dir))))
    return rendered.select(
        F.col("id").alias("ex_id"), "text", "words", F.size("words").alias("length")
    )


def example_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow table that ordering works on: ``(ex_id, length)``, written once."""
    return cut_lineage(examples(spark, sf_dir).select("ex_id", "length"), "lengths")


def encoded_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """``(doc_id, input_ids)``, all words of whole texts and the end token, the vocabulary
    and the end id."""
    docs = with_words(corpus(spark, sf_dir))
    vocab = build_vocab(docs)
    eos, unknown = special_ids(vocab)
    ids = encode(docs, vocab, unknown)
    ids = ids.withColumn("input_ids", append_eos(F.col("input_ids"), eos))
    return ids, vocab, eos


def with_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("attention_mask", ones_like(F.col("input_ids")))


def dictionary(spark: SparkSession, sf_dir: str, min_docs: int = 5) -> DataFrame:
    """Words that occur in at least ``min_docs`` documents, as a written table."""
    words = with_words(corpus(spark, sf_dir)).select(
        F.explode(F.array_distinct("words")).alias("word")
    )
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return cut_lineage(counts.where(F.col("docs") >= min_docs).select("word"), "dictionary")


def logit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 10 == 0, -100).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ctx_id"), F.col("embedding").alias("logits"), label.alias("label")
    )


def steps(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("step"),
        F.col("value").alias("loss_sum"),
        (F.col("user_id") % 2).alias("correct"),
        F.lit(1).cast("long").alias("total"),
    )


def metric_rows(events: DataFrame) -> DataFrame:
    """Metric rows; ``val`` rows have no learning rate."""
    val = F.col("event_id") % 5 == 0
    return events.select(
        F.col("event_id").alias("step"),
        F.when(val, "val").otherwise("train").alias("phase"),
        F.col("value").alias("loss"),
        (F.col("user_id") / 1000).alias("accuracy"),
        F.when(~val, 0.0004).alias("learning_rate"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns ``(conv_id, turn, text)``."""
    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return rows.where("role = 'assistant'").select("conv_id", "turn", "text")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(step, prompt_id, input, output)``: each reply after the turn before it."""
    rows = texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    asked = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("input"))
    return (
        rows.where("role = 'assistant'")
        .join(asked, ["conv_id", "turn"], "left")
        .select(
            F.col("turn").cast("int").alias("step"),
            F.col("conv_id").cast("int").alias("prompt_id"),
            F.coalesce("input", F.lit("")).alias("input"),
            F.col("text").alias("output"),
        )
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(prompt_id, input, words)``: the benchmark texts as prompts."""
    rows = with_words(texts(spark, sf_dir, "benchmark", "item_id", "text"))
    return rows.select(F.col("item_id").alias("prompt_id"), F.col("text").alias("input"), "words")


def checkpoint_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing ``(task, file)``, one name in fifty off the pattern."""
    key = F.col("o_orderkey")
    name = F.concat(
        F.when(key % 50 == 0, "x_").otherwise(""),
        F.format_string("epoch%d_step%d.pth", F.col("o_custkey") % 3, key),
    )
    task = F.when(key % 2 == 0, "pretrain").otherwise("finetune")
    return table(spark, sf_dir, "orders").select(task.alias("task"), name.alias("file"))
