"""Keyed JSON feeds: one object whose members are recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.positions import global_position, id_levels, running_total
from millrace.sources.scratch import cut_lineage, hadoop_path, join_files, new_folder

# ``picture_link`` is not part of the schema, so parsing drops it.
FEED_SCHEMA = (
    "map<string, struct<title: string, ingredients: array<string>, instructions: string>>"
)


def members(text: Column, mode: str = "FAILFAST") -> Column:
    """The members of a JSON object as a map, which keeps repeated keys in order.

    Malformed text is an error, or with the mode ``PERMISSIVE`` NULL.
    """
    return F.from_json(text, FEED_SCHEMA, {"mode": mode})


def write_object_feed(entries: DataFrame, path: str, pieces: int) -> None:
    """Write ``(ordinal, key, recipe)`` as one file that is one JSON object, in order.

    Members are written in ``pieces`` ranges of ordinals, which must be unique, by a task
    each; the pieces then become one file (see ``join_files``).
    """
    spark = entries.sparkSession
    whole = F.to_json(F.create_map(F.col("key"), F.col("recipe")))
    member = F.substring(whole, F.lit(2), F.length(whole) - 2)
    bounds = entries.agg(F.min("ordinal"), F.max("ordinal")).first()
    opened = F.when(F.col("ordinal") == bounds[0], F.lit("{")).otherwise(F.lit(","))
    closed = F.when(F.col("ordinal") == bounds[1], F.lit("}")).otherwise(F.lit(""))
    text = entries.select("ordinal", F.concat(opened, member, closed).alias("value"))
    folder = new_folder(spark, "pieces")
    ordered = text.repartitionByRange(pieces, "ordinal").sortWithinPartitions("ordinal")
    ordered.select("value").write.mode("overwrite").text(folder)
    join_files(spark, folder, path)
    fs, written = hadoop_path(spark, folder)
    fs.delete(written, True)


def read_feed(spark: SparkSession, path: str, source: str, lines: bool = False) -> DataFrame:
    """Rows ``(source, ordinal, key, recipe)`` of a keyed feed, in file order.

    By default each file is one JSON object, of any size (see ``object_pieces``).  With
    ``lines`` every line is an object with one or more members; the ordinal then runs over
    all files in name order.  Malformed text is an error; ``read_feed_parts`` sets it aside.
    """
    good, bad = read_feed_parts(spark, path, source, lines)
    # Evaluated where a bad row is read, and only there.
    message = F.concat(F.lit("malformed feed: "), "file", F.lit(", place "), F.col("place").cast("string"))
    failed = bad.select(F.raise_error(message).cast("string").alias("source"))
    for name, kind in good.dtypes[1:]:
        failed = failed.withColumn(name, F.lit(None).cast(kind))
    return good.unionByName(failed.where("source IS NOT NULL"))


def read_feed_parts(
    spark: SparkSession, path: str, source: str, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The entries of a keyed feed, and what of it could not be read.

    Rejects ``(source, file, place, text)`` are whole lines, or the members between two
    objects of a file; ``place`` numbers them in their file, from 1.
    """
    pieces = line_pieces(spark, path) if lines else object_pieces(spark, path)
    pieces = cut_lineage(pieces.withColumn("entries", members(F.col("text"), "PERMISSIVE")), "feed")
    read = pieces.where("entries IS NOT NULL").select(
        "file", "place", F.posexplode("entries").alias("_at", "key", "recipe")
    )
    # Lines are one sequence over all files, objects one each.
    levels = [F.col("file"), *id_levels("place")] if lines else id_levels("place")
    placed = global_position(
        read, levels=levels, order=[F.col("place"), F.col("_at")], name="ordinal", by=[] if lines else ["file"]
    )
    good = tag_source(placed.select((F.col("ordinal") - 1).alias("ordinal"), "key", "recipe"), source)
    bad = pieces.where("entries IS NULL").select(F.lit(source).alias("source"), "file", "place", "text")
    return good, bad


def placed_text(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``(file, value, _block, _line)`` of text files, written; the last two give the order."""
    text = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("_size"),
        "value",
        F.col("_metadata.file_block_start").alias("_block"),
        # Grows along a block; its values may differ between runs, so they are written.
        F.monotonically_increasing_id().alias("_line"),
    )
    return cut_lineage(text, "feed-text")


def line_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, text)`` of all lines that are not blank."""
    text = placed_text(spark, path)
    placed = global_position(text, levels=[F.col("_block")], order=[F.col("_line")], name="place", by=["file"])
    return placed.where("trim(value) <> ''").select("file", "place", F.col("value").alias("text"))


def object_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, text)``: files of one JSON object each, cut into objects of a few
    of its members, which any task can parse.

    The files are read in splits and fragments that end at a closing brace, in a string or
    not.  What a fragment does depends on what comes before it, so that is added up over
    fragments, split by split: the parity of quotes tells which of its text is in strings,
    and the braces and brackets outside them give the depth.  Where a brace closes the
    last object inside the outermost one, the file may be cut.  The fragments between two
    cuts, wherever they were read, are one piece: as large as its members.

    An object that is not closed, or text behind it, makes a piece that cannot be parsed.
    """
    text = placed_text(spark, path, lineSep="}")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = F.split(plain, '"', -1)

    def depth(parity: int) -> Column:
        """What a fragment adds if ``parity`` quotes, even or odd, come before it."""
        outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")
        opened = F.length(F.regexp_replace(outside, r"[^{\[]", ""))
        return opened - F.length(F.regexp_replace(outside, r"[^\]]", ""))

    narrow = text.select(
        "file", "_block", "_line", "_size",
        (F.size(parts) - 1).alias("_quotes"), depth(0).alias("_even"), depth(1).alias("_odd"),
        (F.octet_length("value") + 1).alias("_bytes"), (F.trim(F.translate("value", "\t\r\n", "")) == "").alias("_blank"),
    )

    def add_up(df: DataFrame, value: Column, name: str) -> DataFrame:
        return running_total(df, value, [F.col("_block")], [F.col("_line")], name, by=["file"])

    placed = add_up(add_up(narrow, F.col("_quotes"), "_before"), F.col("_bytes"), "_start")
    # The last fragment of a file may end with the file, not with a brace.
    ended = (F.col("_start") + F.col("_bytes") <= F.col("_size")).cast("int")
    closes = ended * ((F.col("_before") + F.col("_quotes")) % 2 == 0).cast("int")
    placed = placed.withColumn("_closes", closes).withColumn(
        "_adds", F.when(F.col("_before") % 2 == 0, F.col("_even")).otherwise(F.col("_odd")) - F.col("_closes")
    )
    deep = add_up(placed, F.col("_adds"), "_depth").withColumn("_depth", F.col("_depth") + F.col("_adds"))
    cut = ((F.col("_closes") == 1) & (F.col("_depth") <= 1)).cast("int")
    numbered = add_up(deep.withColumn("_cut", cut), F.col("_cut"), "_place").where(~F.col("_blank") | (ended == 1))
    # A file that ends inside its object lacks a piece.
    ends = numbered.groupBy("file").agg(F.max_by("_depth", "_line").alias("depth"), (F.max("_place") + 2).alias("place"))
    unclosed = ends.where("depth <> 0").select("file", "place", F.lit("").alias("text"))
    numbered = numbered.select("_line", F.col("_place") + 1, "_depth", "_closes", ended.alias("_ended"))
    fragment = F.concat("value", F.when(F.col("_ended") == 1, "}").otherwise(""))
    pieces = (
        text.select("file", "_line", "value")
        .join(numbered.toDF("_line", "place", "_depth", "_closes", "_ended"), "_line")
        .groupBy("file", "place")
        .agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("_line", fragment.alias("text")))).getField("text"), "").alias("text"),
            F.max_by(F.when(F.col("_closes") == 1, F.col("_depth")), "_line").alias("depth"),
        )
    )
    first = F.col("place") == 1
    start = F.when(first, r"^\s*\{").otherwise(r"^\s*,")
    body = F.regexp_replace("text", start, "{")
    # A cut inside the outermost object lacks its closing brace; one that closes it has it.
    whole = F.when(F.col("depth") == 1, F.concat(body, F.lit("}"))).when(F.col("depth") == 0, body)
    begins = F.when(first, F.col("text").rlike(r"^\s*\{")).otherwise(F.col("text").rlike(r"^\s*[,}]"))
    last = F.regexp_replace("text", r"^\s*\}", "{}")
    whole = F.when(F.col("text").rlike(r"^\s*\}\s*$") & ~first, last).otherwise(whole)
    text = F.when(begins, F.coalesce(whole, "text")).otherwise(F.concat(F.lit("?"), "text"))
    return pieces.select("file", "place", text.alias("text")).unionByName(unclosed)


def tag_source(entries: DataFrame, source: str) -> DataFrame:
    """Add the constant source; an embedded ``picture_link`` is dropped."""
    fields = ("title", "ingredients", "instructions")
    recipe = F.when(
        F.col("recipe").isNotNull(), F.struct(*[F.col(f"recipe.{f}").alias(f) for f in fields])
    )
    return entries.select(
        F.lit(source).alias("source"), "ordinal", "key", recipe.alias("recipe")
    )


def split_rejects(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable entries, and those whose member is null instead of an object."""
    return entries.where("recipe is not null"), entries.where("recipe is null")
