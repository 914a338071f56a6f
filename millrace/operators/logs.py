"""Metric tables, evaluation results and checkpoint listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import hadoop_path

METRICS = ("loss", "accuracy", "perplexity", "learning_rate", "grad_norm")
# Fixed value: the name pattern of checkpoint files, anchored at the start only.
CHECKPOINT_NAME = r"^epoch(\d+)_step(\d+)\.pth"


def truncate_for_resume(metrics: DataFrame, start_step: int) -> DataFrame:
    """Drop rows logged after ``start_step``; a fresh start keeps everything."""
    return metrics.where(F.col("step") <= start_step) if start_step > 0 else metrics


def metrics_long(
    metrics: DataFrame, names: tuple[str, ...] = METRICS, purge_step: int | None = None
) -> DataFrame:
    """One row ``(tag, value, step)`` per metric present; a resume purges later points."""
    names = [n for n in names if n in metrics.columns]
    points = metrics.select(
        "step", "phase", *[F.col(n).cast("double").alias(n) for n in names]
    ).unpivot(["step", "phase"], names, "metric", "value")
    tag = F.when(F.coalesce("phase", F.lit("")) == "", F.col("metric")).otherwise(
        F.concat_ws("/", "phase", "metric")
    )
    points = points.where("value is not null").select(tag.alias("tag"), "value", "step")
    return points if purge_step is None else points.where(F.col("step") < purge_step)


def five_decimals(value: Column) -> Column:
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .otherwise(F.format_string("%.5f", value))
    )


def metric_lines(metrics: DataFrame, task: str, names: tuple[str, ...] = METRICS) -> DataFrame:
    """``line``: ``[TASK:PHASE] Step n | name: value | …`` with the metrics present."""
    parts = []
    for name in (n for n in names if n in metrics.columns):
        real = dict(metrics.dtypes)[name] in ("double", "float")
        shown = five_decimals(F.col(name)) if real else F.col(name).cast("string")
        parts.append(F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name}: "), shown)))
    phase = F.coalesce("phase", F.lit(""))
    tag = F.when(phase == "", task.upper()).otherwise(
        F.concat(F.lit(f"{task.upper()}:"), F.upper(phase))
    )
    head = F.concat(F.lit("["), tag, F.lit("] Step "), F.col("step").cast("string"), F.lit(" | "))
    return metrics.select("step", "phase", F.concat(head, F.concat_ws(" | ", *parts)).alias("line"))


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Hand every row to every sink, computing the input once."""
    df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()


def upsert_results(existing: DataFrame, new: DataFrame, key: str = "step") -> DataFrame:
    """Replace the rows of steps evaluated again and add new steps."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(
        *existing.columns
    ).unionByName(new)


def metric_series(metrics: DataFrame) -> DataFrame:
    """Summary metrics in numeric step order; steps may be stored as strings."""
    return metrics.withColumn("step", F.col("step").cast("int")).orderBy("step")


def prompt_history(prompts: DataFrame, steps: DataFrame, prompt: str) -> DataFrame:
    """Output and diversity of one prompt at every step of ``steps``.

    A step's first match counts; a step without one has ``found`` false and NULLs.
    """
    first = F.min_by(F.struct("output", "diversity"), F.col("prompt_id"))
    found = prompts.where(F.col("input") == prompt).groupBy("step").agg(first.alias("_first"))
    return (
        steps.select("step")
        .distinct()
        .join(found, "step", "left")
        .select(
            F.col("step").cast("int").alias("step"),
            F.col("_first").isNotNull().alias("found"),
            F.col("_first.output").alias("output"),
            F.col("_first.diversity").alias("diversity"),
        )
    )


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """Per task, the file of the highest epoch and step; NULL if no name matches."""
    epoch = F.regexp_extract("file", CHECKPOINT_NAME, 1)
    step = F.regexp_extract("file", CHECKPOINT_NAME, 2)
    rank = F.when(
        epoch != "", F.struct(epoch.cast("decimal(38,0)"), step.cast("decimal(38,0)"), F.col("file"))
    )
    return files.groupBy("task").agg(F.max_by("file", rank).alias("file"))


def list_checkpoints(spark: SparkSession, root: str, tasks: list[str]) -> DataFrame:
    """File listing ``(task, file)`` of the task folders under ``root``."""
    listing = spark.createDataFrame([], "task string, file string")
    for task in tasks:
        folder = f"{root}/{task}"
        fs, target = hadoop_path(spark, folder)
        if fs.exists(target):
            # Only paths are selected, so no file content is read.
            files = spark.read.format("binaryFile").load(folder)
            name = F.element_at(F.split("path", "/"), -1)
            listing = listing.unionByName(files.select(F.lit(task).alias("task"), name.alias("file")))
    return listing
