"""Queries: feeds, recipe tables, cleaning, rendering and cleaning reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as text_functions
from millrace.functions.text import LINE_END, WHITESPACE_CLASS
from millrace.operators import metrics, recipes
from millrace.operators.positions import global_position, id_levels
from millrace.plans import sql, views
from millrace.plans.registry import query
from millrace.sources import feeds as feed_source
from millrace.sources import tables
from millrace.sources.scratch import new_folder

FEEDS = ("ar", "epi", "fn")
NL = "\n"


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Recipe columns with the ingredient list as one text."""
    return df.select(
        *columns,
        *[c for c in ("id", "source", "title") if c in df.columns],
        F.array_join("ingredients", NL).alias("ingredients"),
        "instructions",
    )


FLAT = "id, source, title, array_to_string(ingredients, chr(10)) AS ingredients, instructions"

FEED_ROWS = f"""{sql.RECIPES}, feed AS (
  SELECT id - 1 AS ordinal, (id - 1) % 3 AS feed_rank,
         CASE (id - 1) % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'epi' ELSE 'fn' END AS source,
         ((id - 1) // 4)::VARCHAR AS key, title, ingredients, instructions
  FROM recipes)"""

MERGED = f"""{FEED_ROWS}, merged AS (
  SELECT key, arg_max(source, p) AS source, arg_max(title, p) AS title,
         arg_max(ingredients, p) AS ingredients, arg_max(instructions, p) AS instructions,
         min(p) AS place
  FROM (SELECT *, feed_rank * 1000000000000 + ordinal AS p FROM feed) GROUP BY key)"""


FED = f"""WITH {FEED_ROWS} SELECT source,
      row_number() OVER (PARTITION BY source ORDER BY ordinal) - 1 AS ordinal, key, title,
      array_to_string(ingredients, chr(10)) AS ingredients, instructions FROM feed"""


@query(FED)
def read_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds written as JSON lines, one member per line, and read back in order."""
    read = []
    for source, feed in zip(FEEDS, views.feeds(spark, sf_dir)):
        path = new_folder(spark, "feed")
        member = F.to_json(F.create_map(F.col("key"), F.col("recipe")))
        feed.orderBy("ordinal").select(member.alias("value")).write.mode("overwrite").text(path)
        read.append(feed_source.read_feed(spark, path, source, lines=True))
    return feed_columns(read)


def feed_columns(read: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, read).select(
        "source", "ordinal", "key", "recipe.title",
        F.array_join("recipe.ingredients", NL).alias("ingredients"), "recipe.instructions",
    )


@query(FED)
def read_object_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of one file each, all of it one object, read in splits."""
    read = []
    pieces = tables.buckets_for(spark, f"{sf_dir}/documents.parquet", least=8)
    for source, feed in zip(FEEDS, views.feeds(spark, sf_dir)):
        path = new_folder(spark, "object")
        feed_source.write_object_feed(feed, path, pieces)
        read.append(feed_source.read_feed(spark, path, source))
    return feed_columns(read)


@query(
    f"""WITH {FEED_ROWS}, lines AS (
      SELECT *, ordinal % 11 = 3 AS broken, row_number() OVER (PARTITION BY source ORDER BY ordinal) AS place FROM feed)
    SELECT source, row_number() OVER (PARTITION BY source, broken ORDER BY ordinal) - 1 AS ordinal,
      CASE WHEN broken THEN NULL ELSE key END AS key, CASE WHEN broken THEN NULL ELSE title END AS title,
      CASE WHEN broken THEN '{{broken ' || key ELSE NULL END AS rejected
    FROM lines"""
)
def feed_line_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds with broken lines: the good ones in their order, the others set aside."""
    parts = []
    for source, feed in zip(FEEDS, views.feeds(spark, sf_dir)):
        path = new_folder(spark, "lines")
        member = F.to_json(F.create_map(F.col("key"), F.col("recipe")))
        line = F.when(F.col("ordinal") % 11 == 3, F.concat(F.lit("{broken "), "key")).otherwise(member)
        feed.orderBy("ordinal").select(line.alias("value")).write.mode("overwrite").text(path)
        good, bad = feed_source.read_feed_parts(spark, path, source, lines=True)
        parts.append(good.select("source", "ordinal", "key", "recipe.title", F.lit(None).cast("string").alias("rejected")))
        placed = global_position(bad, [F.col("file"), *id_levels("place")], [F.col("place")], "ordinal")
        none = F.lit(None).cast("string")
        parts.append(
            placed.select("source", (F.col("ordinal") - 1).alias("ordinal"), none.alias("key"), none.alias("title"), F.col("text").alias("rejected"))
        )
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH {FEED_ROWS}, members AS (
      SELECT ordinal // 50 AS file, source, key || '.' || ordinal AS key, title, ordinal % 7 = 0 AS empty,
             row_number() OVER (PARTITION BY source, ordinal // 50 ORDER BY key || '.' || ordinal) - 1 AS place
      FROM feed)
    SELECT source, place, key, CASE WHEN NOT empty THEN title END AS title, empty AS rejected FROM members"""
)
def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of whole-object files, split into usable members and those that are null."""
    usable, rejected = [], []
    for source, feed in zip(FEEDS, views.feeds(spark, sf_dir)):
        path = new_folder(spark, "objects")
        name = F.concat_ws(".", "key", F.col("ordinal").cast("string")).alias("name")
        recipe = F.when(F.col("ordinal") % 7 != 0, F.col("recipe")).alias("recipe")
        entries = F.sort_array(F.collect_list(F.struct(name, recipe)))
        objects = feed.groupBy(F.floor(F.col("ordinal") / 50).alias("file")).agg(entries.alias("entries"))
        text = F.to_json(F.map_from_entries("entries"), {"ignoreNullFields": "false"})
        objects.select("file", text.alias("value")).write.mode("overwrite").partitionBy("file").text(path)
        good, bad = feed_source.split_rejects(feed_source.read_feed(spark, path, source))
        usable.append(good.withColumn("rejected", F.lit(False)))
        rejected.append(bad.withColumn("rejected", F.lit(True)))
    rows = reduce(DataFrame.unionByName, usable + rejected)
    return rows.select("source", F.col("ordinal").alias("place"), "key", "recipe.title", "rejected")


def tagged(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        feed_source.tag_source(feed, source)
        for source, feed in zip(FEEDS, views.feeds(spark, sf_dir))
    ]


@query(
    f"""WITH {FEED_ROWS} SELECT source, ordinal, key, title,
      array_to_string(ingredients, chr(10)) AS ingredients, instructions FROM feed"""
)
def tag_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tagged(spark, sf_dir)
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(
        "source", "ordinal", "key", "recipe.title",
        F.array_join("recipe.ingredients", NL).alias("ingredients"), "recipe.instructions",
    )


@query(
    f"""WITH {MERGED} SELECT key, source, title, array_to_string(ingredients, chr(10)) AS ingredients, instructions,
      (place // 1000000000000)::INT AS feed_rank, place % 1000000000000 AS ordinal FROM merged"""
)
def merge_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.merge_feeds(*tagged(spark, sf_dir)).select(
        "key", "source", "recipe.title", F.array_join("recipe.ingredients", NL).alias("ingredients"),
        "recipe.instructions", "feed_rank", "ordinal",
    )


@query(
    f"""WITH {MERGED} SELECT {FLAT} FROM (
      SELECT *, row_number() OVER (ORDER BY place) AS id FROM merged)"""
)
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(recipes.assign_ids(recipes.merge_feeds(*tagged(spark, sf_dir))))


@query(f"WITH {sql.RECIPES} SELECT {FLAT} FROM recipes")
def write_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "recipes")
    tables.write_recipes(views.recipes(spark, sf_dir), path)
    return flat(tables.read_recipes(spark, path))


@query(
    f"""WITH {sql.RECIPES} SELECT id, source, title || '!' AS title,
      array_to_string(ingredients, chr(10)) AS ingredients, instructions FROM recipes"""
)
def replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace a table twice, the second time from its own first version."""
    path = new_folder(spark, "recipes")
    tables.replace_table(views.recipes(spark, sf_dir), path)
    first = tables.read_table(spark, path)
    tables.replace_table(first.withColumn("title", F.concat("title", F.lit("!"))), path)
    return flat(tables.read_table(spark, path))


def labelled_ids(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    labels = views.table(spark, sf_dir, "labels").where(label)
    return labels.select((F.col("doc_id") + 1).alias("id")).distinct()


UPDATED = f"""WITH {sql.RECIPES}, updates AS (
      SELECT id, title || ' 2' AS title
      FROM recipes JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON l.doc_id + 1 = id)
    SELECT r.id, CASE WHEN u.id IS NULL THEN source ELSE 'edit' END AS source,
      coalesce(u.title, r.title) AS title,
      array_to_string(ingredients, chr(10)) AS ingredients, instructions
    FROM recipes r LEFT JOIN updates u USING (id)"""


def poor_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two updates of each recipe labelled as poor, and some of unknown recipes."""
    target = views.recipes(spark, sf_dir)
    poor = labelled_ids(spark, sf_dir, "quality = 0")
    edits = target.join(poor, "id").withColumn("source", F.lit("edit"))
    unknown = edits.withColumn("id", -F.col("id"))
    early = edits.withColumns({"title": F.concat("title", F.lit(" 1")), "seq": F.lit(1)})
    late = edits.withColumns({"title": F.concat("title", F.lit(" 2")), "seq": F.lit(2)})
    return early.unionByName(late).unionByName(unknown.withColumn("seq", F.lit(3)))


@query(UPDATED)
def update_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes labelled as poor get two updates, of which the later counts."""
    return flat(recipes.update_matched(views.recipes(spark, sf_dir), poor_updates(spark, sf_dir), "seq"))


@query(UPDATED)
def update_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a table laid out by id, written as its next version and read back."""
    path = new_folder(spark, "bucketed")
    buckets = tables.buckets_for(spark, f"{sf_dir}/documents.parquet", least=8)
    tables.replace_bucketed(views.recipes(spark, sf_dir), path, buckets=buckets)
    target = tables.read_bucketed(spark, path, buckets=buckets)
    updated = recipes.update_matched(target, poor_updates(spark, sf_dir), "seq")
    tables.replace_bucketed(updated, path, buckets=buckets, dealt=True)
    return flat(tables.read_bucketed(spark, path, buckets=buckets))


@query(
    f"""WITH {sql.RECIPES} SELECT {FLAT} FROM recipes
    WHERE id NOT IN (SELECT doc_id + 1 FROM labels WHERE toxic = 1)"""
)
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes labelled as toxic are deleted."""
    toxic = labelled_ids(spark, sf_dir, "toxic = 1")
    return flat(recipes.delete_by_id(views.recipes(spark, sf_dir), toxic))


@query(
    f"""WITH {sql.RECIPES} SELECT CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS id,
      CASE WHEN id % 4 = 0 THEN '' ELSE source END AS source, title,
      CASE WHEN id % 5 = 0 THEN '' ELSE array_to_string(ingredients, chr(10)) END AS ingredients,
      CASE WHEN id % 6 = 0 THEN '' ELSE instructions END AS instructions FROM recipes"""
)
def load_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes with zero ids and NULL fields, loaded with their defaults."""
    gaps = views.recipes(spark, sf_dir).select(
        F.when(F.col("id") % 6 == 0, None)
        .when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 4 != 0, F.col("source")).alias("source"),
        "title",
        F.when(F.col("id") % 5 != 0, F.col("ingredients")).alias("ingredients"),
        F.when(F.col("id") % 6 != 0, F.col("instructions")).alias("instructions"),
    )
    return flat(recipes.load_recipes(gaps))


@query(f"WITH {sql.RECIPES} SELECT {FLAT} FROM recipes WHERE id = 100")
def get_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup in a stored table; the predicate prunes its row groups."""
    path = new_folder(spark, "recipes")
    tables.replace_table(views.recipes(spark, sf_dir), path)
    return flat(recipes.get_recipe(tables.read_table(spark, path), 100))


@query("SELECT doc_id, text, length(text) AS chars FROM documents")
def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read_corpus(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "text", F.char_length("text").cast("long").alias("chars"))


def on_documents(spark: SparkSession, sf_dir: str, function) -> DataFrame:
    return views.corpus(spark, sf_dir).select("doc_id", function(F.col("text")).alias("text"))


def on_pages(spark: SparkSession, sf_dir: str, function) -> DataFrame:
    pages = views.texts(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", function(F.col("html")).alias("html"))


@query(f"SELECT doc_id, {sql.accents('text')} AS text FROM documents")
def remove_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_documents(spark, sf_dir, text_functions.remove_accents)


def with_advertisement(c: str) -> str:
    return f"(chr(160) || 'ADVERTISEMENT ' || {c} || ' ADVERTISEMENT' || chr(10))"


@query(f"SELECT doc_id, {sql.advertisement(with_advertisement('text'))} AS text FROM documents")
def remove_advertisement(spark: SparkSession, sf_dir: str) -> DataFrame:
    def framed(c):
        c = F.concat(F.lit("\xa0ADVERTISEMENT "), c, F.lit(" ADVERTISEMENT\n"))
        return text_functions.remove_advertisement(c)

    return on_documents(spark, sf_dir, framed)


@query(f"SELECT doc_id, {sql.whitespace('text')} AS text FROM documents")
def replace_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_documents(spark, sf_dir, text_functions.replace_whitespace)


PHRASED = "(text || ' Watch how to make this recipe. ' || text)"


@query(f"SELECT doc_id, {sql.phrases(PHRASED)} AS text FROM documents")
def replace_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    def doubled(c):
        c = F.concat(c, F.lit(" Watch how to make this recipe. "), c)
        return text_functions.replace_phrases(c)

    return on_documents(spark, sf_dir, doubled)


@query(f"SELECT page_id, {sql.html('html')} AS html FROM pages")
def remove_html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_pages(spark, sf_dir, text_functions.remove_html_tags)


@query(f"SELECT doc_id, {sql.special('text')} AS text FROM documents")
def remove_special_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_documents(spark, sf_dir, text_functions.remove_special_characters)


CLEANED = f"""{sql.RECIPES}, cleaned AS (
  SELECT id, source, {sql.clean_text('title')} AS title,
         {sql.clean_list('ingredients')} AS ingredients,
         {sql.clean_text('instructions')} AS instructions FROM recipes)"""
COMPLETE = "title <> '' AND len(ingredients) > 0 AND instructions <> ''"


@query(f"WITH {CLEANED} SELECT {FLAT} FROM cleaned")
def clean_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(recipes.clean_recipes(views.recipes(spark, sf_dir)))


@query(f"SELECT page_id, {sql.clean_text('html')} AS html FROM pages")
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning order of titles and instructions on raw web pages."""
    return on_pages(spark, sf_dir, text_functions.clean_text)


@query(
    f"""WITH {sql.RECIPES} SELECT id,
      'Id: ' || id || chr(10) || chr(10) || 'Source: ' || source || chr(10) || chr(10)
        || {sql.rendered()} AS text FROM recipes"""
)
def recipe_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = recipes.rendered(include_source=True, include_id=True)
    return views.recipes(spark, sf_dir).select("id", rendered.alias("text"))


WS = WHITESPACE_CLASS
BLOCK = f"regexp_extract(text, 'Ingredients:{WS}*((?:- .+\\n?)+)', 1)"


@query(
    f"""WITH {sql.RECIPES}, strings AS (SELECT id, {sql.rendered()} AS text FROM recipes)
    SELECT id, {sql.strip(f"regexp_extract(text, 'Title:{WS}*(.+)', 1)")} AS title,
      CASE WHEN {BLOCK} = '' THEN '' ELSE array_to_string(list_transform(
        regexp_split_to_array({sql.strip(BLOCK)}, '{LINE_END}'),
        lambda x: {sql.strip('substr(x, 3)')}), chr(10)) END AS ingredients,
      {sql.strip(f"regexp_extract(text, '(?s)Instructions:{WS}*(.+)', 1)")} AS instructions
    FROM strings"""
)
def recipe_from_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = views.recipes(spark, sf_dir).select("id", recipes.rendered().alias("text"))
    parsed = strings.select("id", text_functions.recipe_from_string(F.col("text")).alias("r"))
    return flat(parsed.select("id", "r.*"))


@query(f"WITH {sql.RECIPES} SELECT id, {sql.FINETUNE_TEXT} AS text FROM recipes")
def finetune_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.finetune_text(views.recipes(spark, sf_dir)).select("id", "text")


@query(
    f"""SELECT conv_id, turn, '{recipes.BASE_PROMPT}' || {sql.strip("chr(9) || text || '  '")} AS prompt
    FROM conversations WHERE role = 'user'"""
)
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.texts(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    message = F.concat(F.lit("\t"), F.col("text"), F.lit("  "))
    rows = asked.where("role = 'user'").withColumn("message", message)
    return recipes.chat_prompt(rows).select("conv_id", "turn", "prompt")


@query(f"WITH {CLEANED} SELECT {FLAT} FROM cleaned WHERE {COMPLETE}")
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(recipes.drop_incomplete(recipes.clean_recipes(views.recipes(spark, sf_dir))))


@query(
    f"""WITH {CLEANED} SELECT count(*) AS rows_before,
      count(*) FILTER (WHERE {COMPLETE}) AS rows_after FROM cleaned"""
)
def cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.cleaning_report(recipes.clean_recipes(views.recipes(spark, sf_dir)))


@query(
    f"""WITH {CLEANED} SELECT source, count(*) AS recipes,
      sum(len(ingredients))::BIGINT AS ingredients, sum(length(instructions))::BIGINT AS chars
    FROM cleaned WHERE {COMPLETE} GROUP BY source"""
)
def clean_recipes_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes left after cleaning, and their size, per source."""
    kept = recipes.drop_incomplete(recipes.clean_recipes(views.recipes(spark, sf_dir)))
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("recipes"),
        F.sum(F.size("ingredients")).alias("ingredients"),
        F.sum(F.char_length("instructions")).alias("chars"),
    )


LENGTHS = f"""{sql.RECIPES}, lengths AS (
  SELECT id, source, len({sql.words(sql.rendered())}) AS length FROM recipes)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(text_functions.word_tokens(recipes.rendered()))
    return views.recipes(spark, sf_dir).select("id", "source", words.alias("length"))


@query(
    f"""WITH {LENGTHS} SELECT count(*) AS rows, round(avg(length), 6) AS mean_length,
      quantile_cont(length::DOUBLE, 0.5) AS median_length,
      count(*) FILTER (WHERE length > 512) AS too_long FROM lengths"""
)
def length_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = metrics.length_profile(lengths(spark, sf_dir))
    return profile.withColumn("mean_length", F.round("mean_length", 6))


@query(
    f"""WITH {LENGTHS}, q AS (
      SELECT quantile_cont(length::DOUBLE, 0.25) AS q1, quantile_cont(length::DOUBLE, 0.5) AS median,
             quantile_cont(length::DOUBLE, 0.75) AS q3 FROM lengths), flagged AS (
      SELECT length, q1, median, q3, length >= q1 - 1.5::DOUBLE * (q3 - q1)
        AND length <= q3 + 1.5::DOUBLE * (q3 - q1) AS inside FROM lengths, q)
    SELECT q1, median, q3, min(length) FILTER (WHERE inside) AS whisker_low,
      max(length) FILTER (WHERE inside) AS whisker_high,
      count(*) FILTER (WHERE NOT inside) AS outliers FROM flagged GROUP BY q1, median, q3"""
)
def length_boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.length_boxplot(lengths(spark, sf_dir))


@query(
    f"""WITH {LENGTHS}, e AS (SELECT min(length) AS low, max(length) AS high FROM lengths),
    filled AS (SELECT least((length - low) * 50 // (high - low), 49)::INT AS bin, count(*) AS n
      FROM lengths, e GROUP BY 1)
    SELECT r.bin::INT AS bin, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(50)) AS bin) r LEFT JOIN filled f ON f.bin = r.bin"""
)
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.length_histogram(lengths(spark, sf_dir))


@query(
    f"""WITH {LENGTHS} SELECT source, count(*) FILTER (WHERE length > 512) AS too_long
    FROM lengths GROUP BY source"""
)
def long_rows_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.long_rows_by_source(lengths(spark, sf_dir))


@query(
    f"""WITH {sql.RECIPES} SELECT source, id, title, sample_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || id), id)::INT
        AS sample_rank FROM recipes) WHERE sample_rank <= 10"""
)
def sample_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = metrics.sample_per_source(views.recipes(spark, sf_dir), "id")
    return sampled.select("source", "id", "title", "sample_rank")
