"""Words, vocabularies, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.tables import WORKER_TABLE_BYTES, filled, positions_in, values_at
from millrace.functions.text import word_tokens
from millrace.operators.lookups import leading_rows, lookup
from millrace.operators.once import compute_once
from millrace.operators.positions import global_position
from millrace.sources.scratch import cut_lineage


def with_words(df: DataFrame, text: str = "text", tokenizer=None) -> DataFrame:
    """Add ``words``; ``tokenizer`` may be any Column function, e.g. a pandas UDF."""
    return compute_once(df, {"words": (tokenizer or word_tokens)(F.col(text))})


#: Words of a vocabulary, at most: with the end and the unknown token, ids are ints.
MAX_WORDS = 2**31 - 3


def build_vocab(
    df: DataFrame, min_count: int = 1, words: str = "words", size: int = MAX_WORDS
) -> DataFrame:
    """Dense ids by falling count, then by word: ``(word, n, id)``, as a written table.

    The vocabulary has the ``size`` most frequent words.  The end token takes the id after
    the last word, unknown words the one after.
    Levels: at most 64 powers of two of the count, the counts between two of them, and
    ever longer beginnings of words, since most words are met only a few times.
    """
    counts = (
        df.select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count)
    )
    counts = cut_lineage(counts, "word-counts")
    placed = global_position(
        counts,
        levels=[-F.floor(F.log2("n")), -F.col("n"), F.substring("word", 1, 3), F.substring("word", 1, 9)],
        order=[F.col("word")],
        name="id",
    )
    vocab = placed.where(F.col("id") <= min(size, MAX_WORDS)).select("word", "n", (F.col("id") - 1).cast("int").alias("id"))
    return cut_lineage(vocab, "vocab")


def special_ids(vocab: DataFrame) -> tuple[int, int]:
    """Ids of the end (and pad) token and of unknown words."""
    size = vocab.count()
    return size, size + 1


def encode(
    df: DataFrame,
    vocab: DataFrame,
    unknown: int,
    key: str = "doc_id",
    words: str = "words",
    keep: list[str] | None = None,
    worker_bytes: int = WORKER_TABLE_BYTES,
    **bounds: int,
) -> DataFrame:
    """``(key, *keep, input_ids)``: the ids of each row's words, in order.

    Ids follow falling frequency, so the first words of a vocabulary cover nearly all of a
    text: as many as fit ``worker_bytes`` go to the workers, and rows stay where they are.
    Of a larger vocabulary, only the words that the workers miss are exploded and looked up.
    """
    keys = [key, *(keep or [])]
    near, size = leading_rows(vocab.select("word"), worker_bytes)
    ids = positions_in(vocab.where(F.col("id") < near).orderBy("id"), "word")(F.col(words))
    if near == size:
        known = F.transform(ids, lambda id: F.coalesce(id, F.lit(unknown)))
        return compute_once(df.select(*keys, words), {"input_ids": known}).drop(words)
    rows = compute_once(df.select(*keys, words), {"input_ids": ids})
    missed = F.filter(words, lambda word, i: F.get("input_ids", i).isNull())
    far = vocab.where(F.col("id") >= near).select("word", "id")
    late = with_late(rows.select(*keys, "input_ids", missed.alias("_missed")), far, F.coalesce("id", F.lit(unknown)), **bounds)
    return compute_once(late, {"input_ids": filled(F.col("input_ids"), F.col("_late"), "int")}).select(*keys, "input_ids")


def with_late(rows: DataFrame, far: DataFrame, value: Column, **bounds: int) -> DataFrame:
    """``rows`` with the array ``_late`` instead of ``_missed``: what each element of that
    finds by the first column of ``far``, in order; NULL for none.

    Rows are written once and numbered.  Only what is missed is exploded; the rows meet it
    again by their number.
    """
    on = far.columns[0]
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()), "near")
    places = rows.select("_row", F.posexplode("_missed").alias("_place", on))
    found = lookup(places, far, [on], **bounds)
    late = F.sort_array(F.collect_list(F.struct("_place", value.alias("_late")))).getField("_late")
    late = found.groupBy("_row").agg(late.alias("_late"))
    return rows.drop("_missed").join(late, "_row", "left").drop("_row")


def decode(
    df: DataFrame,
    vocab: DataFrame,
    key: str = "doc_id",
    ids: str = "input_ids",
    worker_bytes: int = WORKER_TABLE_BYTES,
    **bounds: int,
) -> DataFrame:
    """``(key, text)``: words joined by a blank; ids outside the vocabulary are dropped.

    As in ``encode``, the first words of a vocabulary go to the workers, and only the ids of
    the others are shuffled.
    """
    near, size = leading_rows(vocab.select("word"), worker_bytes)
    words = values_at(vocab.where(F.col("id") < near).orderBy("id"), "word")
    if near == size:
        return df.select(key, F.array_join(words(F.col(ids)), " ").alias("text"))
    inside = F.filter(ids, lambda id: (id >= 0) & (id < size))
    rows = df.select(key, inside.alias("_ids"))
    far = vocab.where(F.col("id") >= near).select("id", "word")
    rows = rows.withColumn("_missed", F.filter("_ids", lambda id: id >= near))
    late = with_late(rows, far, F.col("word"), **bounds)
    found = filled(words(F.col("_ids")), F.col("_late"), "string")
    return late.select(key, F.array_join(found, " ").alias("text"))


def filter_by_token_length(df: DataFrame, max_tokens: int = 511, tokens: str = "words") -> DataFrame:
    """Keep rows of at most ``max_tokens`` tokens (the end token is added later)."""
    return df.where(F.size(tokens) <= max_tokens)


def prompt_length(text: Column) -> Column:
    """Number of words before the first blank line."""
    return F.size(word_tokens(F.substring_index(text, "\n\n", 1)))
