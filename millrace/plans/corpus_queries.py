"""Queries: tokens, training-set assembly and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.tokens import append_eos, append_eos_truncate
from millrace.operators import assembly, tokens
from millrace.operators.recipes import finetune_text, load_recipes
from millrace.plans import sql, views
from millrace.plans.registry import query
from millrace.sources.scratch import cut_lineage, new_folder


def spaced(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


VOCAB = sql.vocabulary()
ENDED = f"{VOCAB}, {sql.ended()}"
EX_VOCAB = sql.vocabulary("examples", "ex_id")


@query(f"SELECT doc_id, len({sql.words('text')})::INT AS n, {sql.joined(sql.words('text'))} AS words FROM documents")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.with_words(views.corpus(spark, sf_dir))
    return docs.select("doc_id", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))


@query(f"WITH {VOCAB} SELECT word, n, id FROM vocab")
def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.build_vocab(tokens.with_words(views.corpus(spark, sf_dir)))


@query(f"WITH {VOCAB} SELECT doc_id, len(ids)::INT AS n, {sql.joined('ids')} AS ids FROM encoded")
def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.with_words(views.corpus(spark, sf_dir))
    vocab = tokens.build_vocab(docs)
    ids = tokens.encode(docs, vocab, tokens.special_ids(vocab)[1])
    return ids.select("doc_id", F.size("input_ids").alias("n"), spaced("input_ids").alias("ids"))


@query(
    f"""WITH {sql.vocabulary(most=1000)} SELECT doc_id, len(ids)::INT AS n,
      list_count(list_filter(ids, lambda id: id > 1000))::INT AS unknown, {sql.joined('ids')} AS ids FROM encoded"""
)
def encode_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from a vocabulary of the thousand most frequent words."""
    docs = tokens.with_words(views.corpus(spark, sf_dir))
    vocab = tokens.build_vocab(docs, size=1000)
    unknown = tokens.special_ids(vocab)[1]
    ids = tokens.encode(docs, vocab, unknown)
    missed = F.size(F.filter("input_ids", lambda id: id == unknown))
    return ids.select("doc_id", F.size("input_ids").alias("n"), missed.alias("unknown"), spaced("input_ids").alias("ids"))


@query(f"WITH {VOCAB}, {sql.ended(max_length=512)} SELECT doc_id, len(ids)::INT AS n, {sql.joined('ids')} AS ids FROM ended")
def append_eos_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens.with_words(views.corpus(spark, sf_dir))
    vocab = tokens.build_vocab(docs)
    eos, unknown = tokens.special_ids(vocab)
    ids = tokens.encode(docs, vocab, unknown)
    ids = ids.withColumn("input_ids", append_eos_truncate(F.col("input_ids"), eos, 512))
    return ids.select("doc_id", F.size("input_ids").alias("n"), spaced("input_ids").alias("ids"))


@query(
    f"""WITH {VOCAB} SELECT d.doc_id, coalesce(e.text, '') AS text FROM documents d LEFT JOIN (
      SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text
      FROM places JOIN vocab USING (word) GROUP BY doc_id) e ON e.doc_id = d.doc_id"""
)
def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded documents back to text; unknown words and end tokens drop out."""
    ids, vocab, _ = views.encoded_corpus(spark, sf_dir)
    return tokens.decode(ids, vocab)


@query(
    f"""WITH {sql.RECIPES} SELECT id, n FROM (
      SELECT id, len({sql.words(sql.FINETUNE_TEXT)})::INT AS n FROM recipes) WHERE n <= 511"""
)
def filter_by_token_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = tokens.with_words(finetune_text(load_recipes(views.recipes(spark, sf_dir))))
    return tokens.filter_by_token_length(rendered).select("id", F.size("words").alias("n"))


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.seeded_shuffle(views.example_lengths(spark, sf_dir), "ex_id")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.train_val_split(cut_lineage(shuffled(spark, sf_dir), "shuffled"))


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = split(spark, sf_dir).where("split = 'train'")
    return assembly.length_groups(train, "ex_id")


def batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = grouped(spark, sf_dir).select("ex_id", "length", "length_rank", "group_id")
    return assembly.shuffle_batches(cut_lineage(groups, "groups"))


@query(f"WITH {sql.SHUFFLED} SELECT ex_id, length::INT AS length, position FROM shuffled")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(spark, sf_dir).select("ex_id", "length", "position")


@query(
    """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p,
        ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 500 AS j FROM documents)
    SELECT doc_id, row_number() OVER (ORDER BY p + j, p) AS position FROM s"""
)
def buffer_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.buffer_shuffle(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"WITH {sql.SHUFFLED} SELECT ex_id, position, split FROM split")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).select("ex_id", "position", "split")


@query(f"WITH {sql.GROUPED} SELECT ex_id, length::INT AS length, length_rank, group_id FROM grouped")
def length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark, sf_dir).select("ex_id", "length", "length_rank", "group_id")


@query(f"WITH {sql.BATCHED} SELECT ex_id, train_position, batch_id, pos_in_batch FROM batched")
def shuffle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(spark, sf_dir).select("ex_id", "train_position", "batch_id", "pos_in_batch")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples ``(ex_id, input_ids, attention_mask, labels)``."""
    rows = views.examples(spark, sf_dir)
    rows = rows.withColumn("prompt_tokens", tokens.prompt_length(F.col("text")))
    vocab = tokens.build_vocab(rows)
    eos, unknown = tokens.special_ids(vocab)
    ids = tokens.encode(rows, vocab, unknown, "ex_id", keep=["prompt_tokens"])
    ids = ids.withColumn("input_ids", append_eos(F.col("input_ids"), eos))
    return assembly.prompt_masked_labels(views.with_mask(ids), F.col("prompt_tokens"))


LABELLED = f"""{EX_VOCAB}, {sql.ended('ex_id')}, prompts AS (
  SELECT ex_id, len({sql.words("string_split(text, chr(10) || chr(10))[1]")}) AS p FROM examples
), labelled AS (
  SELECT ex_id, ids, list_transform(ids, lambda x, i: CASE WHEN i <= p THEN -100 ELSE x END) AS labels
  FROM ended JOIN prompts USING (ex_id))"""


@query(
    f"""WITH {sql.EXAMPLES}, {LABELLED}
    SELECT ex_id, {sql.joined('ids')} AS ids, {sql.joined('labels')} AS labels FROM labelled"""
)
def prompt_masked_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "ex_id", spaced("input_ids").alias("ids"), spaced("labels").alias("labels")
    )


@query(
    f"""WITH {sql.BATCHED}, {LABELLED}, sized AS (
      SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest
      FROM labelled JOIN batched USING (ex_id)), targets AS (
      SELECT *, CASE WHEN longest <= 128 THEN 128 WHEN longest <= 256 THEN 256
        WHEN longest <= 384 THEN 384 WHEN longest <= 512 THEN 512 ELSE longest END AS target FROM sized)
    SELECT ex_id, batch_id, pos_in_batch, target::INT AS width, len(ids)::BIGINT AS tokens,
      {sql.joined('list_concat(ids, list_transform(range(target - len(ids)), lambda x: 50256))')} AS ids,
      {sql.joined('list_concat(labels, list_transform(range(target - len(ids)), lambda x: -100))')} AS labels
    FROM targets"""
)
def bucket_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine-tune data from end to end: order, batches, labels and padding."""
    batches = batched(spark, sf_dir).select("ex_id", "batch_id", "pos_in_batch")
    rows = cut_lineage(labelled(spark, sf_dir).join(batches, "ex_id"), "batched")
    padded = assembly.bucket_pad(rows)
    return padded.select(
        "ex_id", "batch_id", "pos_in_batch",
        F.size("input_ids").alias("width"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("tokens"),
        spaced("input_ids").alias("ids"), spaced("labels").alias("labels"),
    )


VAL_BATCHES = f"""{sql.SHUFFLED}, val AS (
  SELECT ex_id, row_number() OVER (ORDER BY position) - 1 AS p FROM split WHERE split = 'val')"""


def validation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation examples, in shuffled order, in consecutive batches."""
    rows = cut_lineage(shuffled(spark, sf_dir), "shuffled")
    marked = assembly.train_val_split(rows).where("split = 'val'")
    first = int(rows.count() * 0.9)
    val = marked.withColumn("position", F.col("position") - first)
    return assembly.cut_batches(val).select("ex_id", "batch_id", "pos_in_batch")


@query(
    f"""WITH {VAL_BATCHES}, {LABELLED}, sized AS (
      SELECT *, p // 6 AS batch_id, max(len(ids)) OVER (PARTITION BY p // 6) AS longest
      FROM labelled JOIN val USING (ex_id)), targets AS (
      SELECT *, CASE WHEN longest <= 128 THEN 128 WHEN longest <= 256 THEN 256
        WHEN longest <= 384 THEN 384 WHEN longest <= 512 THEN 512 ELSE longest END AS target FROM sized)
    SELECT ex_id, batch_id, (p % 6)::INT AS pos_in_batch, target::INT AS width,
      {sql.joined('list_concat(ids, list_transform(range(target - len(ids)), lambda x: 50256))')} AS ids
    FROM targets"""
)
def validation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation examples padded like the train ones."""
    rows = labelled(spark, sf_dir).join(validation_rows(spark, sf_dir), "ex_id")
    padded = assembly.bucket_pad(cut_lineage(rows, "validation"))
    return padded.select(
        "ex_id", "batch_id", "pos_in_batch", F.size("input_ids").alias("width"),
        spaced("input_ids").alias("ids"),
    )


def corpus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in order, in batches padded to their longest row."""
    ids, _, _ = views.encoded_corpus(spark, sf_dir)
    order = views.table(spark, sf_dir, "documents").select("doc_id")
    placed = assembly.global_position(order, assembly.id_levels("doc_id"), [F.col("doc_id")])
    batches = cut_lineage(assembly.cut_batches(placed), "batches")
    rows = cut_lineage(views.with_mask(ids).join(batches, "doc_id"), "batched")
    return assembly.pad_to_batch_max(rows)


CORPUS_BATCHES = f"""{VOCAB}, {sql.ended()}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM ended), padded AS (
  SELECT doc_id, p // 6 AS batch_id, (p % 6)::INT AS pos_in_batch, len(ids) AS n,
         list_concat(ids, list_transform(range(max(len(ids)) OVER (PARTITION BY p // 6) - len(ids)),
           lambda x: 50256)) AS ids FROM numbered)"""


@query(
    f"""WITH {CORPUS_BATCHES} SELECT doc_id, batch_id, pos_in_batch, len(ids)::INT AS width,
      n::BIGINT AS tokens, {sql.joined('ids')} AS ids FROM padded"""
)
def pad_to_batch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_batches(spark, sf_dir).select(
        "doc_id", "batch_id", "pos_in_batch", F.size("input_ids").alias("width"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("tokens"),
        spaced("input_ids").alias("ids"),
    )


STREAM = f"""{ENDED}, stream AS (
  SELECT tok, row_number() OVER (ORDER BY doc_id, pos) - 1 AS p, count(*) OVER () AS total
  FROM (SELECT doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM ended)), placed AS (
  SELECT tok, p, p // 462 AS chunk_id, total FROM stream
  UNION ALL SELECT tok, p, p // 462 - 1, total FROM stream WHERE p >= 462 AND p % 462 < 50)"""
PACKED = f"""WITH {STREAM} SELECT chunk_id, count(*)::INT AS n, string_agg(tok, ' ' ORDER BY p) AS ids
FROM placed WHERE chunk_id * 462 + 512 <= total GROUP BY chunk_id"""

SHARDS_PACKED = f"""WITH {ENDED}, stream AS (
  SELECT lang, tok, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) - 1 AS p,
         count(*) OVER (PARTITION BY lang) AS total
  FROM (SELECT doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM ended)
  JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)), placed AS (
  SELECT *, p // 462 AS chunk_id FROM stream
  UNION ALL SELECT *, p // 462 - 1 FROM stream WHERE p >= 462 AND p % 462 < 50)
SELECT lang, chunk_id, count(*)::INT AS n, string_agg(tok, ' ' ORDER BY p) AS ids
FROM placed WHERE chunk_id * 462 + 512 <= total GROUP BY lang, chunk_id"""


@query(PACKED)
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, _, _ = views.encoded_corpus(spark, sf_dir)
    packed = assembly.pack_chunks(cut_lineage(ids, "encoded"))
    return packed.select("chunk_id", F.size("input_ids").alias("n"), spaced("input_ids").alias("ids"))


@query(
    f"""WITH {ENDED}, numbered AS (
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p,
        ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 500 AS j FROM documents), stream AS (
      SELECT tok, row_number() OVER (ORDER BY p + j, p, pos) - 1 AS q, count(*) OVER () AS total
      FROM numbered JOIN (SELECT doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM ended)
      USING (doc_id)), placed AS (
      SELECT tok, q, q // 462 AS chunk_id, total FROM stream
      UNION ALL SELECT tok, q, q // 462 - 1, total FROM stream WHERE q >= 462 AND q % 462 < 50)
    SELECT chunk_id, count(*)::INT AS n, string_agg(tok, ' ' ORDER BY q) AS ids FROM placed
    WHERE chunk_id * 462 + 512 <= total GROUP BY chunk_id"""
)
def pack_shuffled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretraining data from end to end: buffered shuffle, then packing."""
    ids, _, _ = views.encoded_corpus(spark, sf_dir)
    order = assembly.buffer_shuffle(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    rows = cut_lineage(ids.join(cut_lineage(order, "order"), "doc_id"), "shuffled")
    packed = assembly.pack_chunks(
        rows, levels=assembly.id_levels("position"), order=[F.col("position")]
    )
    return packed.select("chunk_id", F.size("input_ids").alias("n"), spaced("input_ids").alias("ids"))


@query(f"WITH {sql.SHUFFLED} SELECT ex_id, position FROM shuffled WHERE position > 100")
def resume_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.resume_from(shuffled(spark, sf_dir), 100).select("ex_id", "position")


@query(f"WITH {sql.SHUFFLED} SELECT ex_id, position FROM shuffled WHERE position > 250")
def resume_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resumed run reads the folders of the positions that are left, and no others."""
    path = new_folder(spark, "ordered")
    assembly.write_ordered(shuffled(spark, sf_dir), path, block_rows=100)
    return assembly.read_ordered(spark, path, 250, block_rows=100).select("ex_id", "position")


@query(
    f"""WITH {CORPUS_BATCHES} SELECT doc_id,
      {sql.joined('list_slice(ids, 1, len(ids) - 1)')} AS inputs,
      {sql.joined('list_transform(list_slice(ids, 2, len(ids)), lambda x, i: CASE WHEN i < n THEN x ELSE -100 END)')} AS labels
    FROM padded"""
)
def next_token_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assembly.next_token_pairs(corpus_batches(spark, sf_dir))
    return pairs.select("doc_id", spaced("inputs").alias("inputs"), spaced("labels").alias("labels"))


@query(
    f"""WITH {VAL_BATCHES} SELECT ex_id, p // 6 AS batch_id, (p % 6)::INT AS pos_in_batch FROM val"""
)
def cut_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows, in shuffled order, in consecutive batches."""
    return validation_rows(spark, sf_dir)
