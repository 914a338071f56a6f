"""One registered query per operator, over the whole given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    conversation_repair,
    decontamination,
    hard_negatives,
    line_spread,
    packed_ids,
    parity_join,
    pieces,
    quality_rules,
    recompression,
    simhash_balls,
    sql,
    suffix_dedup,
    toxicity,
    url_filters,
)
from millrace.llm.registry import query
from millrace.sources.scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that pages are judged by.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query(sql.URLS)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


@query()
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    forest = quality_rules.fit_rules(documents, table(spark, sf_dir, "labels"))
    return quality_rules.judge(documents, forest).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept", "score"
    )


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select(
        "doc_id",
        (toxicity.crc_remainder("doc_id") == 0).alias("held_out"),
        "score",
        "predicted",
    )


def piece_digests(documents: DataFrame) -> DataFrame:
    encoded = pieces.encode_documents(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query()
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


@query()
def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "packed_ids")
    documents = table(spark, sf_dir, "documents")
    packed_ids.write_packed(documents, folder, public_tokenizers.path("word_bpe_49k.json"), end=1)
    return packed_ids.read_packed(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("mark")


def line_digests(marked: DataFrame) -> DataFrame:
    return marked.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.md5(F.col("clean").cast("binary")).alias("kept_md5"),
    )


@query(sql.LINES)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(line_spread.marked_documents(table(spark, sf_dir, "documents")))


@query()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"))


@query()
def op11_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_balls.simhash_components(table(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows dropped (no copy), emptied, stripped of
    sentence ends, repeated or given to the user, by a checksum of their place."""
    blank = F.lit(" ")
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(place.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    changed = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), copies.alias("copies")
    )


@query(sql.CONVERSATIONS)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(damaged(table(spark, sf_dir, "conversations")), F.col("copies"))


@query(sql.NEGATIVES)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(vectors, F.col("vec_id") % 100 == 0, label=label)
