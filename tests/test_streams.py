import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import logs, metrics, recipes
from millrace.sources.tables import RECIPE_SCHEMA
from millrace.streaming import streams
from test_assembly import chunks_of

DOCS = "doc_id long, input_ids array<int>"


def arriving(spark, folder, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(str(folder))


def put(spark, rows, schema, folder, name):
    """One JSON-lines file, as a producer would drop it."""
    lines = spark.createDataFrame(rows, schema).select(F.to_json(F.struct("*"))).collect()
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r[0] for r in lines) + "\n")


def test_packing_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(1)
    docs = [[rng.randint(0, 99) for _ in range(rng.choice([0, 5, 30]))] for _ in range(30)]
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run(first, last):
        for start in range(first, last, 5):
            rows = [(i, docs[i]) for i in range(start, start + 5)]
            put(spark, rows, DOCS, source, f"part-{start:03d}.json")
            stream = arriving(spark, source, DOCS)
            streams.pack_chunks_stream(stream, out, checkpoint, 16, 5).awaitTermination()

    run(0, 15)
    expected, _ = chunks_of(docs[:15], 16, 5)
    assert read(spark, out) == expected
    run(15, 30)
    expected, _ = chunks_of(docs, 16, 5)
    assert read(spark, out) == expected


def test_rows_without_an_order_arrive_too(spark):
    from millrace.plans.stream_queries import run_arriving

    seen = []
    rows = spark.createDataFrame([(None, "x"), (5, "y"), (1, "z"), (9, "w")], "k long, v string")

    def start(stream):
        query = streams.each_batch(stream, lambda batch, _: seen.append(sorted(r.v for r in batch.collect())), checkpoint)
        return query

    from millrace.sources.scratch import new_folder

    checkpoint = new_folder(spark, "offsets")
    run_arriving(rows, "k", start)
    assert [x for x in seen if x] == [["x", "z"], ["y"], ["w"]]


def read(spark, out):
    rows = streams.read_packed(spark, out).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(len(rows)))
    return [r.input_ids for r in rows]


def test_packing_without_overlap_ends_on_a_border(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(3):
        put(spark, [(i, list(range(8)))], DOCS, source, f"part-{i}.json")
        stream = arriving(spark, source, DOCS)
        streams.pack_chunks_stream(stream, out, str(tmp_path / "cp"), 4, 0).awaitTermination()
    assert read(spark, out) == [[0, 1, 2, 3], [4, 5, 6, 7]] * 3


def test_shards_are_packed_on_their_own_over_restarts(spark, tmp_path):
    """A shard may be absent from a batch, come late, have no tokens, or no name."""
    rng = random.Random(3)
    schema = "shard string, " + DOCS
    docs = [(rng.choice(["a", "a", "b", None]), i, [rng.randint(0, 99) for _ in range(rng.choice([0, 4, 30]))]) for i in range(40)]
    docs += [("late", 40 + i, list(range(9))) for i in range(6)] + [("none", 46, [])]
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for overlap, out in ((5, str(tmp_path / "a")), (0, str(tmp_path / "b"))):
        for part, start in enumerate(range(0, len(docs), 8)):
            folder = tmp_path / f"in{overlap}"
            put(spark, docs[start : start + 8], schema, folder, f"part-{part}.json")
            stream = arriving(spark, folder, schema)
            streams.pack_chunks_stream(stream, out, f"{checkpoint}{overlap}", 16, overlap, shard="shard").awaitTermination()
        rows = streams.read_packed(spark, out).collect()
        for shard in ("a", "b", None, "late", "none"):
            own = sorted((r.chunk_id, r.input_ids) for r in rows if r.shard == shard)
            expected, _ = chunks_of([ids for s, _, ids in docs if s == shard], 16, overlap)
            assert own == list(enumerate(expected))


def test_a_shuffled_stream_equals_the_shuffled_table(spark, tmp_path):
    from millrace.operators.assembly import buffer_shuffle

    schema = "doc_id long, text string"
    docs = [(i, f"t{i}") for i in range(200)]
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    start = 0
    for size in (3, 90, 0, 1, 60, 46):
        put(spark, docs[start : start + size], schema, source, f"part-{start:03d}-{size}.json")
        start += size
        stream = arriving(spark, source, schema)
        streams.buffer_shuffle_stream(stream, "doc_id", out, checkpoint, buffer=30).awaitTermination()
        given = spark.read.parquet(f"{out}/rows")
        assert given.count() >= start - 30  # no more than the buffer is held
        got = sorted((r.position, r.doc_id, r.text) for r in streams.read_shuffled(spark, out).collect())
        table = spark.createDataFrame(docs[:start], schema)
        whole = sorted((r.position, r.doc_id, r.text) for r in buffer_shuffle(table, "doc_id", 30).collect())
        assert got == whole
    assert all(abs(position - 1 - i) < 30 for position, i, _ in got)


STEPS = "run string, step long, loss_sum double, correct long, total long"


def test_windows_stay_open_across_batches(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [(run, s, float(s), 1, 2) for s in range(41) for run in ("a", "b")]
    for i, size in enumerate((14, 40, 28)):
        taken, rows = rows[:size], rows[size:]
        put(spark, taken, STEPS, source, f"part-{i}.json")
        streams.accumulate_stream(arriving(spark, source, STEPS), 16, out, checkpoint).awaitTermination()
    got = sorted(tuple(r) for r in streams.read_windows(spark, out).select("run", "step", "loss_sum", "total").collect())
    assert got == [
        (run, end, float(sum(range(end - 16, end))), 32) for run in ("a", "b") for end in (16, 32)
    ]


@pytest.mark.parametrize("steps", [range(50), range(5000, 5024), [s for s in range(32) if s != 3], [3, 4, 6, 2]])
def test_stream_windows_equal_the_batch_windows(spark, tmp_path, steps):
    """Also for runs that resume inside a window, lack a step or come out of order."""
    rows = [("a", s, s / 8, s % 2, 1) for s in steps]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(0, len(rows), 7):
        put(spark, rows[i : i + 7], STEPS, source, f"part-{i:03d}.json")
    streams.accumulate_stream(arriving(spark, source, STEPS), 7, out, str(tmp_path / "cp")).awaitTermination()
    batch = metrics.accumulate_windows(spark.createDataFrame(rows, STEPS).drop("run"), 7)
    assert sorted(streams.read_windows(spark, out).select(batch.columns).collect()) == sorted(batch.collect())


def test_open_windows_stay_few_and_late_rows_are_kept(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(5):
        rows = [(run, s, 1.0, 1, 1) for s in range(i * 40, i * 40 + 40) for run in ("a", None)]
        rows += [("slow", i, 1.0, 1, 1)]  # another run's steps make no row of this one late
        rows += [("a", 3, 1.0, 1, 1)] if i in (1, 4) else []
        put(spark, rows, STEPS, source, f"part-{i}.json")
        stream = arriving(spark, source, STEPS)
        streams.accumulate_stream(stream, 4, out, checkpoint, late=12).awaitTermination()
        assert spark.read.parquet(f"{out}/open/batch={i}").count() <= 2 * 13 + 2
    got = {(r.run, r.step): r.total for r in streams.read_windows(spark, out).collect()}
    assert got == {(run, s): 5 if (run, s) == ("a", 4) else 4 for run in ("a", None) for s in range(4, 201, 4)} | {("slow", 4): 4}
    assert [(r.run, r.window, r.total) for r in streams.read_late(spark, out).collect()] == [("a", 0, 1)]


def test_cleaning_stream_equals_batch(spark, tmp_path):
    rows = [(i, "s", f"Crème {i}" if i % 4 else "½", ["1 cup ADVERTISEMENT"], "a\nb") for i in range(20)]
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i in range(4):
        put(spark, rows[i * 5 : i * 5 + 5], RECIPE_SCHEMA, source, f"part-{i}.json")
    stream = streams.clean_stream(arriving(spark, source, RECIPE_SCHEMA))
    streams.write_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    batch = recipes.drop_incomplete(recipes.clean_recipes(spark.createDataFrame(rows, RECIPE_SCHEMA)))
    assert sorted(spark.read.parquet(out).collect()) == sorted(batch.collect())


def test_a_table_may_be_a_file_or_a_folder(spark, tiny, tmp_path):
    from millrace.plans.stream_queries import clean_stream

    folder = str(tmp_path / "documents.parquet")
    spark.read.parquet(f"{tiny}/documents.parquet").repartition(3).write.parquet(folder)
    assert sorted(clean_stream(spark, str(tmp_path)).collect()) == sorted(clean_stream(spark, tiny).collect())


def test_a_repeated_batch_replaces_its_output(spark, tmp_path):
    lines, points = str(tmp_path / "lines"), str(tmp_path / "points")
    sinks = [
        streams.batch_folder_sink(lines, lambda df: logs.metric_lines(df, "pretrain")),
        streams.batch_folder_sink(points, logs.metrics_long),
    ]
    schema = "step long, phase string, loss double"
    put(spark, [(1, "train", 0.5), (2, "val", 1.5)], schema, tmp_path / "in", "part-0.json")
    for checkpoint in ("first", "lost"):
        stream = arriving(spark, tmp_path / "in", schema)
        query = streams.metrics_stream_fan_out(stream, sinks, str(tmp_path / checkpoint))
        query.awaitTermination()
    assert spark.read.parquet(f"{lines}/*").count() == 2
    assert spark.read.parquet(f"{points}/*").count() == 2


def test_chunks_of_one_shard_are_written_by_many_tasks(spark, tmp_path):
    """They are not shuffled by their shard to be numbered."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(spark, [(i, list(range(64))) for i in range(40)], DOCS, source, "part.json")
    keys = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(key) for key in keys]
    try:
        for key, value in zip(keys, ["false", "-1"]):
            spark.conf.set(key, value)
        streams.pack_chunks_stream(arriving(spark, source, DOCS), out, str(tmp_path / "cp"), 16, 0).awaitTermination()
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)
    chunks = streams.read_packed(spark, out)
    assert chunks.count() == 160
    assert chunks.select(F.input_file_name()).distinct().count() > 1
