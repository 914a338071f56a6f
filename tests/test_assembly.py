import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import tokens as T
from millrace.operators import assembly
from millrace.operators.lookups import lookup
from millrace.operators.tokens import build_vocab, decode, encode, special_ids, with_words


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def lengths_table(spark, n=419):
    rng = random.Random(11)
    # A third of all rows share one length.
    rows = [(i, 100 if i % 3 == 0 else rng.randint(1, 511)) for i in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "ex_id long, length int").repartition(6)


def expected_batches(rows, align=False):
    """Batch and place of the train rows, and the rest in order, from ranks alone.

    The place in the shuffle is the number of rows with a smaller hash; the length rank
    that among train rows with a smaller (length, place); a group's place the number of
    rows in groups with a smaller hash.
    """
    place = {e: rank for rank, (_, e) in enumerate(sorted((md5(f"42:{e}"), e) for e, _ in rows))}
    cut = int(len(rows) * 0.9)
    by_length = sorted((length, place[e], e) for e, length in rows if place[e] < cut)
    group = {e: rank // 6 for rank, (_, _, e) in enumerate(by_length)}
    inner = {e: rank % 6 for rank, (_, _, e) in enumerate(by_length)}
    short = cut // 6 if align and cut % 6 else None
    key = {g: (g == short, md5(f"42:{g}"), g) for g in group.values()}
    flat = sorted(group, key=lambda e: (key[group[e]], inner[e]))
    rest = sorted((p, e) for e, p in place.items() if p >= cut)
    return {e: divmod(i, 6) for i, e in enumerate(flat)}, [e for _, e in rest]


@pytest.mark.parametrize("align", [False, True])
def test_batches_equal_the_sequential_form(spark, align):
    rows, df = lengths_table(spark)
    split = assembly.train_val_split(assembly.seeded_shuffle(df, "ex_id"))
    groups = assembly.length_groups(split.where("split = 'train'"), "ex_id")
    got = assembly.shuffle_batches(groups, align=align).collect()
    expected, val = expected_batches(rows, align)
    assert {r.ex_id: (r.batch_id, r.pos_in_batch) for r in got} == expected
    rest = split.where("split = 'val'").orderBy("position").collect()
    assert [r.ex_id for r in rest] == val


def test_buffer_shuffle_moves_rows_less_than_the_buffer(spark):
    got = assembly.buffer_shuffle(spark.range(2000), "id", buffer=50).collect()
    assert sorted(r.position for r in got) == list(range(1, 2001))
    assert max(abs(r.position - 1 - r.id) for r in got) < 50
    assert [r.id for r in sorted(got, key=lambda r: r.position)] != list(range(2000))


def chunks_of(docs, size, overlap):
    """Chunk k is ``stream[k * stride : k * stride + size]``; the tail starts where the
    next chunk would."""
    stream = [t for tokens in docs for t in tokens]
    stride = size - overlap
    full = max(0, (len(stream) - size) // stride + 1)
    return [stream[k * stride : k * stride + size] for k in range(full)], stream[full * stride :]


@pytest.mark.parametrize("size, overlap", [(512, 50), (16, 5), (7, 0), (4, 3)])
def test_packing_equals_a_walk_over_the_stream(spark, size, overlap):
    rng = random.Random(size)
    docs = [[rng.randint(0, 999) for _ in range(rng.choice([0, 1, 3, 40, 700]))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, input_ids array<int>")
    got = assembly.pack_chunks(df.repartition(5), size=size, overlap=overlap)
    chunks, buffer = chunks_of(docs, size, overlap)
    rows = got.orderBy("chunk_id").collect()
    assert [r.input_ids for r in rows] == chunks
    assert [r.chunk_id for r in rows] == list(range(len(chunks)))
    assert all(r.attention_mask == [1] * size for r in rows)

    kept = assembly.pack_chunks(df, size=size, overlap=overlap, keep_tail=True)
    tail = [r.input_ids for r in kept.where(F.size("input_ids") < size).collect()]
    assert tail == ([buffer] if buffer else [])


@pytest.mark.parametrize("n, count", [(511, 0), (512, 1), (973, 1), (974, 2)])
def test_chunk_counts(spark, n, count):
    df = spark.createDataFrame([(1, list(range(n)))], "doc_id long, input_ids array<int>")
    assert assembly.pack_chunks(df).count() == count


def test_packing_per_shard(spark):
    rows = [(s, d, [d] * 10) for s in ("x", "y") for d in range(9)]
    df = spark.createDataFrame(rows, "shard string, doc_id long, input_ids array<int>")
    got = assembly.pack_chunks(df, size=16, overlap=4, by=["shard"]).collect()
    expected, _ = chunks_of([[d] * 10 for d in range(9)], 16, 4)
    for shard in ("x", "y"):
        mine = sorted((r.chunk_id, r.input_ids) for r in got if r.shard == shard)
        assert [ids for _, ids in mine] == expected


@pytest.mark.parametrize("longest, width", [(1, 128), (128, 128), (129, 256), (512, 512), (600, 600)])
def test_pad_widths(spark, longest, width):
    rows = [(0, [1] * longest, [1] * longest, [2] * longest), (0, [7], [1], [8])]
    df = spark.createDataFrame(
        rows, "batch_id long, input_ids array<int>, attention_mask array<int>, labels array<int>"
    )
    got = assembly.bucket_pad(df).where("input_ids[0] = 7").first()
    assert got.input_ids == [7] + [50256] * (width - 1)
    assert got.attention_mask == [1] + [0] * (width - 1)
    assert got.labels == [8] + [-100] * (width - 1)


def test_pad_to_the_longest_row(spark):
    df = spark.createDataFrame(
        [(0, [1, 2, 3], [1, 1, 1]), (0, [4], [1]), (1, [5], [1])],
        "batch_id long, input_ids array<int>, attention_mask array<int>",
    )
    got = sorted((r.batch_id, r.input_ids, r.attention_mask) for r in assembly.pad_to_batch_max(df).collect())
    assert got == [
        (0, [1, 2, 3], [1, 1, 1]), (0, [4, 50256, 50256], [1, 0, 0]), (1, [5], [1]),
    ]


def test_next_token_pairs(spark):
    ids = [101, 102, 103, 104, 105, 0, 0, 0, 0, 0]
    df = spark.createDataFrame(
        [(ids, [1] * 5 + [0] * 5)], "input_ids array<int>, attention_mask array<int>"
    )
    row = assembly.next_token_pairs(df).first()
    assert row.inputs == ids[:-1]
    assert row.labels == [102, 103, 104, 105] + [-100] * 5
    given = df.withColumn("labels", F.col("input_ids"))
    assert assembly.next_token_pairs(given).first().labels == ids[1:]


def test_short_rows_have_no_pairs(spark):
    df = spark.createDataFrame([([], []), ([1], [1])], "input_ids array<int>, attention_mask array<int>")
    assert [(r.inputs, r.labels) for r in assembly.next_token_pairs(df).collect()] == [([], []), ([], [])]


def test_prompt_labels(spark):
    df = spark.createDataFrame(
        [([5, 6, 7, 8], [1, 1, 1, 0], 2)], "input_ids array<int>, attention_mask array<int>, p int"
    )
    assert assembly.prompt_masked_labels(df, F.col("p")).first().labels == [-100, -100, 7, -100]


def test_long_rows_lose_the_end_token(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],)], "x array<int>")
    got = [r[0] for r in df.select(T.append_eos_truncate(F.col("x"), 9, 3)).collect()]
    assert got == [[1, 2, 3], [1, 9]]


def test_resume_and_cut(spark):
    df = spark.range(1, 15).withColumnRenamed("id", "position")
    batches = assembly.cut_batches(df).collect()
    assert sorted((r.position, r.batch_id, r.pos_in_batch) for r in batches) == [
        (p, (p - 1) // 6, (p - 1) % 6) for p in range(1, 15)
    ]
    assert assembly.resume_from(df, 10).count() == 4


# Vocabulary beside the tasks, broadcast to a join, and shuffled to a join.
@pytest.mark.parametrize(
    "bounds", [{}, {"worker_bytes": 0}, {"worker_bytes": 0, "max_bytes": 0}]
)
def test_vocabulary_and_codec(spark, bounds):
    docs = [(0, "b a b c"), (1, "a b d"), (2, ""), (3, "zz"), (4, None)]
    df = with_words(spark.createDataFrame(docs, "doc_id long, text string"))
    vocab = build_vocab(df, min_count=2)
    assert sorted((r.id, r.word, r.n) for r in vocab.collect()) == [(0, "b", 3), (1, "a", 2)]
    eos, unknown = special_ids(vocab)
    assert (eos, unknown) == (2, 3)
    ids = encode(df, vocab, unknown, **bounds)
    assert {r.doc_id: r.input_ids for r in ids.collect()} == {
        0: [0, 1, 0, 3], 1: [1, 0, 3], 2: [], 3: [3], 4: [],
    }
    back = {r.doc_id: r.text for r in decode(ids, vocab, **bounds).collect()}
    assert back == {0: "b a b", 1: "a b", 2: "", 3: "", 4: ""}


def test_a_vocabulary_of_a_given_size(spark):
    df = with_words(spark.createDataFrame([(0, "a b c a b a d d d d e")], "doc_id long, text string"))
    vocab = build_vocab(df, size=3)
    assert sorted((r.id, r.word) for r in vocab.collect()) == [(0, "d"), (1, "a"), (2, "b")]
    eos, unknown = special_ids(vocab)
    assert (eos, unknown) == (3, 4)
    assert encode(df, vocab, unknown).first().input_ids == [1, 2, 4, 1, 2, 1, 0, 0, 0, 0, 4]


def test_vocabulary_order_over_many_buckets(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(words[i::10],) for i in range(10)], "words array<string>")
    many = build_vocab(df, min_count=2)
    ranked = [r.word for r in many.orderBy("id").collect()]
    counted = {w: words.count(w) for w in set(words)}
    kept = [w for w in counted if counted[w] > 1]
    assert ranked == sorted(kept, key=lambda w: (-counted[w], w.encode()))


def test_another_tokenizer(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    assert with_words(df, tokenizer=lambda c: F.split(c, "")).first().words == ["a", "b"]


@pytest.mark.parametrize("n_seen, folders", [(0, 5), (99, 5), (100, 4), (250, 3), (499, 1), (500, 0)])
def test_a_resume_opens_only_the_folders_that_are_left(spark, tmp_path, n_seen, folders):
    rows = spark.range(1, 501).select(F.col("id").alias("position"), (F.col("id") * 7).alias("x"))
    assembly.write_ordered(rows, str(tmp_path / "o"), block_rows=100)
    left = assembly.read_ordered(spark, str(tmp_path / "o"), n_seen, block_rows=100)
    assert sorted(tuple(r) for r in left.collect()) == [(i, 7 * i) for i in range(n_seen + 1, 501)]
    opened = left.select(F.input_file_name()).distinct().collect()
    assert len(opened) == folders
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan


def test_only_words_beyond_the_worker_table_are_shuffled(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", [60, 30, 15, 8, 4, 2, 1, 1], k=rng.randint(0, 30))) for _ in range(40)]
    # Rows that share a key stay apart; an unknown word is one of those missed.
    docs = [(i // 2, text + (" zz" if i == 3 else "")) for i, text in enumerate(texts)]
    df = with_words(spark.createDataFrame(docs, "doc_id long, text string"))
    vocab = build_vocab(df, min_count=2)
    eos, unknown = special_ids(vocab)
    words = [r.word for r in vocab.orderBy("id").collect()]
    sent = []

    def counted(facts, *args, **bounds):
        sent.append(facts.count())
        return lookup(facts, *args, **bounds)

    monkeypatch.setattr("millrace.operators.tokens.lookup", counted)
    bounds = {"worker_bytes": 4 * len('{"word":"a"}'), "max_bytes": 0}
    ids = encode(df, vocab, unknown, keep=["text"], **bounds)
    assert sent == [sum(w not in words[:4] for _, text in docs for w in text.split())]
    expected = [(key, text, [words.index(w) if w in words else unknown for w in text.split()]) for key, text in docs]
    assert sorted(tuple(r) for r in ids.collect()) == sorted(expected)
    back = decode(ids.withColumn("input_ids", F.concat("input_ids", F.array(F.lit(eos)))), vocab, **bounds)
    assert sorted(tuple(r) for r in back.collect()) == sorted((key, text.replace(" zz", "")) for key, text in docs)
    assert sent[1] == sent[0] - 1
