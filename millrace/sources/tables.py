"""Recipe tables: schema, JSON and Parquet files, versioned replacement."""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.scratch import hadoop_path

RECIPE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("ingredients", T.ArrayType(T.StringType())),
        T.StructField("instructions", T.StringType()),
    ]
)

CORPUS_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("phase", T.StringType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("perplexity", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
        T.StructField("grad_norm", T.DoubleType()),
    ]
)


#: Inputs of at least this size have splits enough and are never shuffled to be spread.
SPREAD_BYTES = 2**30


def spread(df: DataFrame, path: str) -> DataFrame:
    """Fan a small input out to all cores before heavy text work.

    A file with few row groups feeds few tasks.  At most ``SPREAD_BYTES`` are shuffled,
    whatever the size of the cluster.
    """
    spark = df.sparkSession
    fs, target = hadoop_path(spark, path)
    if fs.getContentSummary(target).getLength() >= SPREAD_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def read_corpus(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    split: str | None = None,
    schema: T.StructType = CORPUS_SCHEMA,
    **options: str,
) -> DataFrame:
    """A text corpus, lazily, as a batch or a stream of files.

    ``split`` selects one value of the ``split`` partition folder.
    """
    if split is not None:
        schema = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(schema).options(**options).parquet(path)
    return df if split is None else df.where(F.col("split") == split).drop("split")


def write_recipes(df: DataFrame, path: str, format: str = "json") -> None:
    """Write recipes as JSON lines (or Parquet) with the five recipe fields.

    JSON drops NULL fields; ``read_recipes`` restores them from the schema.
    """
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RECIPE_SCHEMA]
    df.select(*columns).write.mode("overwrite").format(format).save(path)


def read_recipes(
    spark: SparkSession, path: str, format: str = "json", one_array: bool = False
) -> DataFrame:
    """Recipes from files; ``one_array`` reads each JSON file as one array of recipes."""
    reader = spark.read.schema(RECIPE_SCHEMA).format(format)
    return (reader.option("multiLine", True) if one_array else reader).load(path)


RESULT_SCHEMA = (
    "map<string, struct<prompts: array<struct<input: string, output: string, diversity: double, "
    "lexical_validity: double>>, metrics: struct<avg_diversity: double, "
    "avg_lexical_validity: double, self_bleu: double>>>"
)


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Evaluation results kept as one JSON object per file, keyed by step.

    Returns the flat tables, per prompt and per step.
    """
    text = spark.read.text(path, wholetext=True)
    results = text.select(
        F.explode(F.from_json("value", RESULT_SCHEMA, {"mode": "FAILFAST"})).alias("step", "result")
    ).withColumn("step", F.col("step").cast("int"))
    prompts = results.select("step", F.posexplode("result.prompts").alias("prompt_id", "prompt"))
    return prompts.select("step", "prompt_id", "prompt.*"), results.select("step", "result.metrics.*")


VERSION = re.compile(r"_version=(\d+)$")


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions of a table, oldest first."""
    fs, target = hadoop_path(spark, path)
    if not fs.exists(target):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(int(match.group(1)) for match in map(VERSION.search, names) if match)


def version_folder(spark: SparkSession, path: str, version: int) -> str | None:
    """The folder that a version's pointer names; none while its writer still writes it."""
    fs, pointer = hadoop_path(spark, f"{path}/_version={version}")
    stream = fs.open(pointer)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{path}/{name}" if name else None


def replace_table(df: DataFrame, path: str) -> int:
    """Replace the whole table by ``df``, which may itself be read from it.

    Each replacement is written to a folder of its own; once the job has committed, the
    next version number is claimed by creating its pointer file, which fails if another
    writer has been faster and is then tried with the number after.  So readers never
    meet a half-written table and writers never overwrite each other.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return publish(spark, path, folder)


def publish(spark: SparkSession, path: str, folder: str) -> int:
    """Make a written folder the next version of a table."""
    while True:
        versions = table_versions(spark, path)
        version = versions[-1] + 1 if versions else 1
        if claim(spark, f"{path}/_version={version}", folder):
            return version


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file, unless it exists already."""
    fs, target = hadoop_path(spark, path)
    try:
        stream = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in str(error.java_exception.getClass()) or fs.exists(target):
            return False
        raise
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    return True


def expire_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Remove all but the last ``keep`` versions, once no job reads them."""
    fs, _ = hadoop_path(spark, path)
    for version in table_versions(spark, path)[:-keep]:
        folder = version_folder(spark, path, version)
        if folder:
            fs.delete(hadoop_path(spark, folder)[1], True)
        fs.delete(hadoop_path(spark, f"{path}/_version={version}")[1], False)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version of a versioned table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    for version in reversed(table_versions(spark, path)):
        folder = version_folder(spark, path, version)
        if folder:
            return reader.parquet(folder)
    raise FileNotFoundError(f"no committed version under {path}")


#: Buckets of a table that is laid out by its key.
BUCKETS = 64

#: Bytes of input files that a bucket stands for: a task sorts a bucket at once.
BUCKET_BYTES = 2**25


def buckets_for(spark: SparkSession, path: str, least: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table made from the files of ``path``: as many more as these are larger."""
    fs, target = hadoop_path(spark, path)
    return max(least, -(-fs.getContentSummary(target).getLength() // bucket_bytes))


def replace_bucketed(
    df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS, dealt: bool = False
) -> int:
    """``replace_table``, laid out in buckets by ``key``, each sorted by it.

    Joins by the key then read the table where it lies, without a shuffle, and a lookup of
    one key opens one bucket (see ``read_bucketed``).  With fewer buckets than shuffle
    partitions, Spark may shuffle the table after all.  ``dealt`` tells that ``df`` comes
    from such a table, so that its rows already are with those of their bucket.
    """
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, key)
    name = f"written_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", f"{path}/{folder}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry; the files stay
    return publish(spark, path, folder)


def read_bucketed(
    spark: SparkSession, path: str, schema: T.StructType = RECIPE_SCHEMA, key: str = "id", buckets: int = BUCKETS
) -> DataFrame:
    """The current version of a table that ``replace_bucketed`` wrote with these settings."""
    for version in reversed(table_versions(spark, path)):
        folder = version_folder(spark, path, version)
        if folder:
            break
    else:
        raise FileNotFoundError(f"no committed version under {path}")
    name = "bucketed_" + folder.rpartition("data-")[2]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return spark.table(name)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric rows under one fixed schema; absent metrics become NULL."""
    present = set(df.columns)
    columns = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in METRIC_SCHEMA
    ]
    df.select(*columns).write.mode("append").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).option("header", True).csv(path)
