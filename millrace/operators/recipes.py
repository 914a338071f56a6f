"""Recipe preparation: merge, number, mutate, clean, render."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators.lookups import lookup
from millrace.operators.once import compute_once
from millrace.operators.positions import global_position, id_levels
from millrace.sources.scratch import cut_lineage

RECIPE_COLUMNS = ("id", "source", "title", "ingredients", "instructions")
# Fixed value: the prompt in front of every dish name.
BASE_PROMPT = "Write a recipe for the following dish: "


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """Union keyed feeds; a key keeps its first place and its last value.

    Only places are aggregated, so a key that fills a third of the input leaves one
    narrow row per map task; the recipe at a key's last place is joined back once.
    Places must be unique within a feed.
    """
    ranked = [feed.withColumn("feed_rank", F.lit(rank)) for rank, feed in enumerate(feeds)]
    entries = reduce(DataFrame.unionByName, ranked)
    place = F.struct("feed_rank", "ordinal")
    kept = entries.groupBy("key").agg(F.max(place).alias("last"), F.min(place).alias("first"))
    kept = kept.select(
        F.col("last.feed_rank").alias("feed_rank"),
        F.col("last.ordinal").alias("ordinal"),
        F.col("first.feed_rank").alias("_feed_rank"),
        F.col("first.ordinal").alias("_ordinal"),
    )
    return entries.join(kept, ["feed_rank", "ordinal"]).select(
        "key", "source", "recipe", F.col("_feed_rank").alias("feed_rank"), F.col("_ordinal").alias("ordinal")
    )


def assign_ids(merged: DataFrame) -> DataFrame:
    """Recipes numbered 1..N in merged order, with defaults for absent fields."""
    placed = global_position(
        cut_lineage(merged, "merged"),
        levels=[F.col("feed_rank"), *id_levels("ordinal")],
        order=[F.col("ordinal")],
        name="id",
    )
    recipe = F.col("recipe")
    return load_recipes(
        placed.select("id", "source", recipe.title.alias("title"),
                      recipe.ingredients.alias("ingredients"),
                      recipe.instructions.alias("instructions"))
    )


def load_recipes(df: DataFrame) -> DataFrame:
    """Defaults for NULL fields; a missing or zero id becomes -1."""
    id = F.col("id").cast("long")
    empty = F.array().cast("array<string>")
    return df.select(
        F.when(id.isNull() | (id == 0), F.lit(-1)).otherwise(id).cast("long").alias("id"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("ingredients", empty).alias("ingredients"),
        F.coalesce("instructions", F.lit("")).alias("instructions"),
    )


def update_matched(target: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Overwrite all fields of recipes whose id has an update; others are ignored.

    With ``order`` the last update of an id wins; without it ids must be unique.
    Few updates are broadcast, many are shuffled.  Id -1, which any number of rows may
    share, has one update at most: it is set aside and joined as a single row.
    """
    fields = [c for c in RECIPE_COLUMNS if c != "id"]
    rank = F.col(order) if order else F.lit(0)
    latest = updates.groupBy("id").agg(
        F.max(F.struct(rank.alias("_rank"), *fields)).alias("update")
    )
    latest = cut_lineage(latest, "updates")
    shared = F.col("id") == -1
    joined = lookup(target.where(~shared), latest.where(~shared), ["id"]).unionByName(
        target.where(shared).join(F.broadcast(latest.where(shared)), "id", "left")
    )
    found = F.col("update").isNotNull()
    return joined.select(
        "id", *[F.when(found, F.col(f"update.{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    )


def delete_by_id(target: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove the given ids; -1, which may stand for many rows, is refused."""
    if not ids.where("id = -1").isEmpty():
        raise ValueError("id -1 may stand for more than one recipe")
    gone = cut_lineage(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "deletions")
    left = lookup(target, gone, ["id"]).where("_gone is null")
    return left.select(*target.columns)


def get_recipe(df: DataFrame, id: int) -> DataFrame:
    """The recipe with this id, as one row; an unknown id is an error."""
    found = df.where(F.col("id") == id).limit(1)
    if found.isEmpty():
        raise ValueError(f"no recipe with id {id}")
    return load_recipes(found)


def clean_recipes(df: DataFrame) -> DataFrame:
    """Clean titles, ingredient lists and instructions, each in its own order."""
    return compute_once(
        df,
        {
            "title": text.clean_text(F.col("title")),
            "ingredients": text.clean_ingredients(F.col("ingredients")),
            "instructions": text.clean_text(F.col("instructions")),
        },
    )


def is_complete() -> Column:
    return (
        (F.col("title") != "") & (F.size("ingredients") > 0) & (F.col("instructions") != "")
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep recipes with a title, at least one ingredient entry and instructions."""
    return df.where(is_complete())


def cleaning_report(df: DataFrame) -> DataFrame:
    """Rows before and after ``drop_incomplete``, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(is_complete()).alias("rows_after")
    )


def rendered(include_source: bool = False, include_id: bool = False) -> Column:
    """The rendered text of the recipe in this row."""
    return text.recipe_to_string(
        F.col("title"),
        F.col("ingredients"),
        F.col("instructions"),
        source=F.col("source") if include_source else None,
        id=F.col("id") if include_id else None,
    )


def finetune_text(df: DataFrame, base_prompt: str = BASE_PROMPT) -> DataFrame:
    """Prompt, title, blank line and rendered recipe, as ``text``."""
    prompt = F.concat(F.lit(f"{base_prompt} "), F.col("title"), F.lit("\n\n"))
    return df.withColumn("text", F.concat(prompt, rendered()))


def chat_prompt(df: DataFrame, base_prompt: str = BASE_PROMPT) -> DataFrame:
    """Prompt and trimmed message, as ``prompt``."""
    return df.withColumn("prompt", F.concat(F.lit(base_prompt), text.py_strip(F.col("message"))))
