"""Queries run as streams; their results must equal the batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import logs
from millrace.plans import views
from millrace.plans.corpus_queries import PACKED, SHARDS_PACKED, spaced
from millrace.plans.metric_queries import FANNED, metric_rows, sink_rows, summary_rows, windows
from millrace.plans.recipe_queries import CLEANED, COMPLETE, FLAT, flat
from millrace.plans.registry import query
from millrace.sources.scratch import cut_lineage, hadoop_path, new_folder
from millrace.sources.tables import spread
from millrace.streaming import streams


#: Parts that a given table arrives in, each taken by a run of the stream of its own.
ARRIVALS = 4


def run_arriving(rows: DataFrame, by: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """``rows`` arriving in parts in the order of ``by``, null first.

    Every part is written by as many tasks as it has and taken by a run that goes on from
    the checkpoint of the one before, so the stream is restarted between parts.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "arriving")
    low, high = rows.agg(F.min(by), F.max(by)).first()
    part = F.floor((F.col(by) - low) * ARRIVALS / (high - low + 1)) if low is not None else F.lit(0)
    for i in range(ARRIVALS):
        rows.where(F.coalesce(part, F.lit(0)) == i).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream of its own files."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(views.table(spark, sf_dir, name).schema)
    fs, target = hadoop_path(spark, path)
    if fs.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(sf_dir)


@query(f"WITH {CLEANED} SELECT {FLAT} FROM cleaned WHERE {COMPLETE}")
def clean_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(stream(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet")
    cleaned = streams.clean_stream(views.recipe_columns(documents))
    path = new_folder(spark, "cleaned")
    streams.write_stream(cleaned, path, new_folder(spark, "offsets")).awaitTermination()
    return flat(spark.read.schema(cleaned.schema).parquet(path))


@query(PACKED)
def pack_chunks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _, _ = views.encoded_corpus(spark, sf_dir)
    path, offsets = new_folder(spark, "packed"), new_folder(spark, "offsets")
    run_arriving(cut_lineage(ids, "encoded"), "doc_id", lambda rows: streams.pack_chunks_stream(rows, path, offsets))
    packed = streams.read_packed(spark, path)
    return packed.select("chunk_id", F.size("input_ids").alias("n"), spaced("input_ids").alias("ids"))


@query(SHARDS_PACKED)
def pack_shards_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language a token stream of its own."""
    ids, _, _ = views.encoded_corpus(spark, sf_dir)
    shards = views.table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = cut_lineage(ids.join(shards, "doc_id"), "encoded")
    path, offsets = new_folder(spark, "packed"), new_folder(spark, "offsets")
    run_arriving(rows, "doc_id", lambda rows: streams.pack_chunks_stream(rows, path, offsets, shard="lang"))
    packed = streams.read_packed(spark, path).withColumnRenamed("shard", "lang")
    return packed.select("lang", "chunk_id", F.size("input_ids").alias("n"), spaced("input_ids").alias("ids"))


@query(
    f"""WITH moved AS (
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS source,
             ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 500 AS jitter FROM documents)
    SELECT doc_id, row_number() OVER (ORDER BY source + jitter, source) AS position FROM moved"""
)
def buffer_shuffle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's places are those of the whole table shuffled at once."""
    rows = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    path, offsets = new_folder(spark, "shuffled"), new_folder(spark, "offsets")
    run_arriving(rows, "doc_id", lambda rows: streams.buffer_shuffle_stream(rows, "doc_id", path, offsets))
    return streams.read_shuffled(spark, path).select("doc_id", "position")


#: Steps that a resumed run with a gap still has: it starts inside a window.
RESUMED = "step >= 1005 AND step <> 1030"


@query(
    f"""SELECT 'whole' AS run, * FROM ({windows()}) UNION ALL
    SELECT 'resumed' AS run, * FROM ({windows(RESUMED)})"""
)
def accumulate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a whole run, and of one that resumes inside a window and lacks a step."""
    rows = views.steps(views.table(spark, sf_dir, "events"))
    both = rows.withColumn("run", F.lit("whole")).unionByName(rows.where(RESUMED).withColumn("run", F.lit("resumed")))
    path, offsets = new_folder(spark, "windows"), new_folder(spark, "offsets")
    run_arriving(both, "step", lambda steps: streams.accumulate_stream(steps, 16, path, offsets))
    return summary_rows(streams.read_windows(spark, path))


@query(FANNED)
def metrics_stream_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, points = new_folder(spark, "lines"), new_folder(spark, "points")
    sinks = [
        streams.batch_folder_sink(lines, lambda df: logs.metric_lines(df, "pretrain")),
        streams.batch_folder_sink(points, logs.metrics_long),
    ]
    offsets = new_folder(spark, "offsets")
    run_arriving(metric_rows(spark, sf_dir), "step", lambda rows: streams.metrics_stream_fan_out(rows, sinks, offsets))
    return sink_rows(spark.read.parquet(f"{lines}/*"), spark.read.parquet(f"{points}/*"))
