"""Streaming forms: the batch operators over arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.assembly import jitter, pack_chunks
from millrace.operators.lookups import lookup
from millrace.operators.metrics import loss_summary
from millrace.operators.positions import global_position, id_levels
from millrace.operators.recipes import clean_recipes, drop_incomplete
from millrace.sources.scratch import cut_lineage, free_table


def clean_stream(recipes: DataFrame) -> DataFrame:
    """Clean and filter arriving recipes: the stateless batch plan, unchanged."""
    return drop_incomplete(clean_recipes(recipes))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything available to Parquet, once per row, and stop."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def each_batch(
    df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch available now; it must be idempotent."""
    return (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def carried(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame | None:
    """What the batch before this one left to be carried on; none before the first."""
    if batch_id == 0:
        return None
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id - 1}")


CHUNK_SCHEMA = "shard string, chunk_id bigint, input_ids array<int>, attention_mask array<int>"


def pack_chunks_stream(
    docs: DataFrame, path: str, checkpoint: str, size: int = 512, overlap: int = 50, shard: str | None = None
) -> StreamingQuery:
    """Pack arriving ``(doc_id, input_ids)`` rows, carrying the open chunks along.

    With ``shard``, a column, every shard is a token stream of its own, like
    ``pack_chunks(by=[shard])``.  Each micro-batch is packed by the distributed batch
    plan, behind the tokens that were left over; only those (fewer than ``size`` a shard)
    and the number of the shard's next chunk are carried, one row per shard, written
    beside the chunks under the batch's id.  A repeated batch overwrites its own output,
    so restarts neither lose nor repeat chunks.  Order is arrival order, then ``doc_id``.
    """
    name = F.col(shard).cast("string") if shard else F.lit(None).cast("string")

    def keyed(shard: Column) -> Column:
        """A key that joins; rows without a shard are one, too."""
        return F.when(shard.isNull(), "0").otherwise(F.concat(F.lit("1"), shard)).alias("shard")

    named = F.when(F.col("shard") != "0", F.expr("substring(shard, 2)")).alias("shard")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(keyed(name), "doc_id", "input_ids", F.lit(1).alias("_late"))
        left = carried(spark, f"{path}/tail", batch_id, CHUNK_SCHEMA)
        if left is None:
            left = spark.createDataFrame([], CHUNK_SCHEMA)
        left = left.withColumn("shard", keyed(F.col("shard")))
        before = left.select("shard", F.lit(0).cast("long").alias("doc_id"), "input_ids", F.lit(0).alias("_late"))
        rows = rows.unionByName(before)
        # One row per shard: whose stream goes on where.
        first = rows.select("shard").distinct().join(left.select("shard", F.col("chunk_id").alias("_first")), "shard", "left")
        first = cut_lineage(first.select("shard", F.coalesce("_first", F.lit(0)).alias("_first")), "shards")
        packed = pack_chunks(
            rows,
            size=size,
            overlap=overlap,
            levels=[F.col("_late"), *id_levels("doc_id")],
            order=[F.col("_late"), F.col("doc_id")],
            by=["shard"],
            keep_tail=True,
        )
        # A shard's chunks are never shuffled by the shard, which may be the only one.
        packed = lookup(packed, first, ["shard"]).withColumn("chunk_id", F.col("chunk_id") + F.col("_first"))
        packed.persist()
        full = F.size("input_ids") == size
        columns = [named, "chunk_id", "input_ids", "attention_mask"]
        packed.where(full).select(*columns).write.mode("overwrite").parquet(f"{path}/chunks/batch={batch_id}")
        # A shard that ends on a chunk border, or has no token yet, keeps its next number only.
        done = packed.where(full).groupBy("shard").agg((F.max("chunk_id") + 1).alias("_next"))
        open_ = packed.where(~full).select("shard", F.col("chunk_id").alias("_open"), "input_ids", "attention_mask")
        none = F.array().cast("array<int>")
        tail = first.join(done, "shard", "left").join(open_, "shard", "left").select(
            named,
            F.coalesce("_open", "_next", "_first").alias("chunk_id"),
            F.coalesce("input_ids", none).alias("input_ids"),
            F.coalesce("attention_mask", none).alias("attention_mask"),
        )
        tail.write.mode("overwrite").parquet(f"{path}/tail/batch={batch_id}")
        packed.unpersist()
        free_table(first)

    return each_batch(docs, handle, checkpoint)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """All chunks a packing stream has written."""
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks/*")


def buffer_shuffle_stream(
    rows: DataFrame, key: str, path: str, checkpoint: str, buffer: int = 500, seed: int = 42
) -> StreamingQuery:
    """Shuffle arriving rows within a buffer, as ``buffer_shuffle`` does a whole table.

    A row moves by less than ``buffer`` places, by a hash of its key, so it can be given
    out once that many rows came after it: at most ``buffer`` rows are carried to the next
    micro-batch.  Each batch writes what it gives out, with positions that go on from the
    last one, and what it holds, under its id; a repeated batch replaces both.  Rows of a
    batch are taken in the order of ``key``.  ``read_shuffled`` adds the rows still held.
    """
    schema = rows.select("*").schema.add("_source", "long").add("_moved", "long")

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held, seen, given = spark.createDataFrame([], schema), 0, 0
        if batch_id:
            held = spark.read.schema(schema).parquet(f"{path}/held/batch={batch_id - 1}")
            seen, given = spark.read.parquet(f"{path}/count/batch={batch_id - 1}").first()
        placed = global_position(batch, id_levels(key), [F.col(key)], name="_source")
        placed = placed.withColumn("_source", F.col("_source") + seen)
        moved = placed.withColumn("_moved", F.col("_source") + jitter(key, buffer, seed))
        moved = cut_lineage(held.unionByName(moved), "moved")
        seen += moved.count() - (seen - given)
        # A row yet to come is at least at the place after all that were seen.
        ready = F.col("_moved") <= seen
        order = [F.col("_moved"), F.col("_source")]
        out = global_position(moved.where(ready), id_levels("_moved"), order)
        out = out.withColumn("position", F.col("position") + given).drop("_source", "_moved")
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        given += moved.where(ready).count()
        moved.where(~ready).write.mode("overwrite").parquet(f"{path}/held/batch={batch_id}")
        counts = spark.createDataFrame([(seen, given)], "seen long, given long")
        counts.write.mode("overwrite").parquet(f"{path}/count/batch={batch_id}")
        free_table(moved)

    return each_batch(rows, handle, checkpoint)


def read_shuffled(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a shuffled stream with their ``position``, those still held at the end."""
    out = spark.read.parquet(f"{path}/rows").drop("batch")
    last = spark.read.parquet(f"{path}/count").orderBy(F.desc("batch")).first()
    held = spark.read.schema(out.drop("position").schema.add("_source", "long").add("_moved", "long"))
    held = held.parquet(f"{path}/held/batch={last['batch']}")
    rest = global_position(held, id_levels("_moved"), [F.col("_moved"), F.col("_source")])
    return out.unionByName(rest.withColumn("position", F.col("position") + last["given"]).drop("_source", "_moved"))


WINDOW_SCHEMA = "run string, window bigint, loss_sum double, correct bigint, total bigint, last bigint"

#: Windows that stay open behind the newest one of a run.
LATE_WINDOWS = 64


def accumulate_stream(
    steps: DataFrame, n: int, path: str, checkpoint: str, late: int = LATE_WINDOWS
) -> StreamingQuery:
    """Sums of windows of ``n`` steps of each run, reported once the window's last step
    has come, whatever came before it (see ``read_windows``).

    ``steps(run, step, loss_sum, correct, total)``.  A micro-batch is summed by run and
    window before it meets the windows carried from the batch before: those within
    ``late`` windows of their run's newest one, so state stays bounded however long a run
    is.  A run that starts or resumes inside a window, or lacks a step, is reported like
    the batch form does; a row that comes late reports its window anew, and one that comes
    later than ``late`` windows is put aside (see ``read_late``).  Each batch writes its
    reports and its open windows under its id; a repeated batch replaces them.
    """
    keys, sums = ["run", "window"], ["loss_sum", "correct", "total"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("window", F.floor(F.col("step") / n))
        new = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], F.max("step").alias("last"))
        new = new.withColumn("new", F.lit(True))
        left = carried(spark, f"{path}/open", batch_id, WINDOW_SCHEMA)
        if left is None:
            left = spark.createDataFrame([], WINDOW_SCHEMA)
        known = left.groupBy("run").agg(F.max("window").alias("_newest"))
        marked = new.join(known, "run", "left").withColumn("_late", F.coalesce(F.col("window") < F.col("_newest") - late, F.lit(False)))
        marked = cut_lineage(marked, "windows")
        in_time = marked.where(~F.col("_late")).select(*keys, *sums, "last", "new")
        both = in_time.unionByName(left.withColumn("new", F.lit(False)))
        merged = both.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in sums], F.max("last").alias("last"), F.max("new").alias("new")
        )
        merged = cut_lineage(merged, "windows")
        columns = [*keys, *sums, "last"]
        done = merged.where(F.col("new") & (F.pmod("last", F.lit(n)) == n - 1)).select(*columns)
        done.write.mode("overwrite").parquet(f"{path}/done/batch={batch_id}")
        newest = merged.groupBy("run").agg(F.max("window").alias("_newest"))
        open_ = merged.join(newest, "run").where(F.col("window") >= F.col("_newest") - late).select(*columns)
        open_.write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
        marked.where("_late").select(*columns).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        for table in (marked, merged):
            free_table(table)

    return each_batch(steps, handle, checkpoint)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Summaries of all finished windows, each as last reported."""
    reports = spark.read.schema(f"{WINDOW_SCHEMA}, batch bigint").parquet(f"{path}/done")
    values = F.struct("loss_sum", "correct", "total", "last")
    latest = reports.groupBy("run", "window").agg(F.max_by(values, "batch").alias("sums"))
    rows = latest.select(
        "run", (F.col("sums.last") + 1).alias("step"), "sums.loss_sum", "sums.correct", "sums.total"
    )
    return loss_summary(rows)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Sums per window of the rows that came too late for it."""
    return spark.read.schema(f"{WINDOW_SCHEMA}, batch bigint").parquet(f"{path}/late")


def metrics_stream_fan_out(
    metrics: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str
) -> StreamingQuery:
    """Hand every micro-batch to every sink together with its id.

    A batch may come again after a failure: sinks replace what they wrote for
    that id (see ``batch_folder_sink``).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return each_batch(metrics, handle, checkpoint)


def batch_folder_sink(
    path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df
) -> Callable[[DataFrame, int], None]:
    """A sink that writes each micro-batch to its own folder, replacing a retry's."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
