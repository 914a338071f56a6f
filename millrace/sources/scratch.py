"""Shared scratch space and written intermediate tables.

Long chains are cut by writing a Parquet table under the folder the cluster
names in ``spark.checkpoint.dir``: columnar, computed once, and readable after
any executor is lost. Without that setting the session's warehouse folder, which
all executors share as well, holds them.
"""

from __future__ import annotations

import os
import shutil
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"

# Shuffle files of a finished write are of no more use: its table is read instead.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    root = spark.conf.get(WAREHOUSE_DIR).rstrip("/") + "/_scratch"
    if root.startswith(("file:", "/")) and not spark.conf.get("spark.master", "local").startswith("local"):
        warnings.warn(f"{CHECKPOINT_DIR} is unset: {root} must be a folder that all executors share", stacklevel=2)
    return root


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path object on it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh scratch folder, removed when the session's file system closes."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    fs, target = hadoop_path(spark, path)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, a finished job's shuffle files are removed at once."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    with shuffles_freed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` gave, once nothing reads it."""
    spark = df.sparkSession
    root = hadoop_path(spark, scratch_root(spark))[1].toUri().getPath()
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    for folder in folders:
        fs, target = hadoop_path(spark, folder)
        if target.toUri().getPath().startswith(root):
            fs.delete(target, True)


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """Make the text files of ``folder``, in name order, one file under the folder ``path``.

    Where a file may be written at any place, every one is copied by a task of its own; a
    repeated copy writes the same bytes again.  Other stores know only files that one
    writer writes from start to end, so there one task reads all of them.
    """
    fs, target = hadoop_path(spark, folder)
    files = [f for f in fs.listStatus(target) if f.getPath().getName().startswith("part-") and f.getLen()]
    files.sort(key=lambda f: f.getPath().getName())
    if fs.getUri().getScheme() != "file" or not files:
        text = spark.read.text([f.getPath().toString() for f in files] or folder)
        order = [F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
        placed = text.select("value", *[c.alias(f"_order{i}") for i, c in enumerate(order)])
        lines = placed.orderBy(*placed.columns[1:]).select("value")
        lines.coalesce(1).write.mode("overwrite").text(path)
        return
    whole = hadoop_path(spark, f"{path}/part-00000.txt")[1].toUri().getPath()
    parts, start = [], 0
    for file in files:
        parts.append((file.getPath().toUri().getPath(), whole, start))
        start += file.getLen()

    def copy_into(part: tuple[str, str, int]) -> None:
        """Copy a file to its place in the whole, which others may be writing elsewhere."""
        source, target, start = part
        with open(source, "rb") as read, os.fdopen(os.open(target, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as write:
            write.seek(start)
            shutil.copyfileobj(read, write, 2**20)

    spark.sparkContext.parallelize(parts, len(parts)).foreach(copy_into)
