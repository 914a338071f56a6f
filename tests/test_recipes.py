import json

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.operators import logs, recipes
from millrace.sources import feeds, scratch, tables

SCHEMA = tables.RECIPE_SCHEMA


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def feed(spark, source, members):
    data = [
        (source, i, k, (None if v is None else (str(v), [str(v)], str(v))))
        for i, (k, v) in enumerate(members)
    ]
    return spark.createDataFrame(
        data,
        "source string, ordinal long, key string, "
        "recipe struct<title string, ingredients array<string>, instructions string>",
    )


def test_merge_keeps_first_place_and_last_value(spark):
    merged = recipes.merge_feeds(
        feed(spark, "ar", [("z", 1), ("a", 2)]),
        feed(spark, "epi", [("b", 3), ("z", 4)]),
        feed(spark, "fn", [("a", 5)]),
    )
    got = recipes.assign_ids(merged).select("id", "title", "source").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "4", "epi"), (2, "5", "fn"), (3, "3", "epi")]


def test_merge_of_duplicate_keys_in_one_feed(spark):
    merged = recipes.merge_feeds(feed(spark, "ar", [("k", 1), ("m", 2), ("k", 3)]))
    got = recipes.assign_ids(merged).select("id", "title").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "3"), (2, "2")]


def test_read_feed_as_one_object_and_as_lines(spark, tmp_path):
    members = [("k%03d" % i, {"title": f"t{i}", "ingredients": ["x"], "instructions": "y",
                              "picture_link": None}) for i in range(50)]
    members.append(("k000", {"title": "again"}))
    whole = tmp_path / "whole.json"
    whole.write_text("{" + ",".join(f"{json.dumps(k)}:{json.dumps(v)}" for k, v in members) + "}")
    lines = tmp_path / "lines"
    lines.mkdir()
    text = [json.dumps({k: v}) for k, v in members]
    (lines / "part-0.json").write_text("\n".join(text[:20]) + "\n")
    (lines / "part-1.json").write_text("\n".join(text[20:]) + "\n")

    one = rows(feeds.read_feed(spark, str(whole), "ar").select("ordinal", "key", "recipe.title"))
    many = rows(
        feeds.read_feed(spark, str(lines), "ar", lines=True).select("ordinal", "key", "recipe.title")
    )
    assert one == many == [(i, k, v["title"]) for i, (k, v) in enumerate(members)]


ODD_MEMBERS = [
    ("a", {"title": 'q " } { ] [ \\', "ingredients": ["}", "x{", '\\"}'], "instructions": "l1\n}\tl2"}),
    ("a", None),
    ("b}", {"title": "}}}", "ingredients": [], "instructions": None, "picture_link": {"deep": [{"x": [1]}, {}]}}),
    ("c", {}),
    ("d", {"title": "é 日本 👍}", "ingredients": ["y" * 700], "instructions": "z}" * 300}),
    ("e\\", {"title": "end"}),
    ("f", None),
    ("g", None),
]


def objects(text, folder, name):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


@pytest.mark.parametrize("split", ["300b", "128m"])
@pytest.mark.parametrize("indent", [None, 2])
def test_an_object_is_read_in_splits_of_any_size(spark, tmp_path, split, indent):
    for i, members in enumerate([ODD_MEMBERS * 5, [], ODD_MEMBERS[3:4], ODD_MEMBERS[1:2], ODD_MEMBERS[:6]]):
        separator = ",\n  " if indent else ","
        body = separator.join(f"{json.dumps(k, ensure_ascii=i == 1)}: {json.dumps(v, indent=indent)}" for k, v in members)
        objects("{" + body + "}" + "\n" * (i % 2), tmp_path / "in", f"f{i}.json")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        good, bad = feeds.read_feed_parts(spark, str(tmp_path / "in"), "ar")
        got = [(r.ordinal, r.key, r.recipe and r.recipe.title, r.recipe and r.recipe.instructions) for r in good.collect()]
        assert bad.count() == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    expected = []
    for members in [ODD_MEMBERS * 5, ODD_MEMBERS[3:4], ODD_MEMBERS[1:2], ODD_MEMBERS[:6]]:
        expected += [(i, k, v and v.get("title"), v and v.get("instructions")) for i, (k, v) in enumerate(members)]
    key = lambda r: (r[0], r[1], str(r[2]), str(r[3]))
    empty = lambda r: (*r[:2], *(x if x else None for x in r[2:]))
    assert sorted(map(empty, got), key=key) == sorted(map(empty, expected), key=key)


MALFORMED = [
    '{"a": {"title": "t"', '{"a": {"title": "t"}', '{"a": null', '{"a": {"title": "t"}} x', '{"a": {"title": "t}', "[1, 2]",
    '{"a": {"title": "t"}}, "b": {}}', '{"a": {"title" "t"}}',
]


@pytest.mark.parametrize("text", MALFORMED)
def test_a_malformed_feed_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        feeds.read_feed(spark, str(tmp_path / "bad.json"), "ar").collect()


def test_bad_members_of_an_object_are_set_aside(spark, tmp_path):
    good = ['"k%d": {"title": "t%d"}' % (i, i) for i in range(6)]
    good[3] = '"k3": {"title" "t3"}'
    objects("{" + ", ".join(good) + "}", tmp_path / "in", "a.json")
    objects('{"x": {"title": "y"}}', tmp_path / "in", "b.json")
    entries, bad = feeds.read_feed_parts(spark, str(tmp_path / "in"), "epi")
    assert sorted(r.key for r in entries.collect()) == ["k0", "k1", "k2", "k4", "k5", "x"]
    (row,) = bad.collect()
    assert (row.source, row.file.rpartition("/")[2], row.place) == ("epi", "a.json", 4) and "k3" in row.text


def test_bad_lines_are_set_aside_with_file_and_place(spark, tmp_path):
    lines = ['{"a": {"title": "1"}}', "", "{broken", '{"b": null, "c": {"title": "2"}}', "null", '{"d": {"title": "3"}} ']
    objects("\n".join(lines), tmp_path / "in", "a.json")
    objects('"text"\n{"e": {"title": "4"}}\n', tmp_path / "in", "b.json")
    entries, bad = feeds.read_feed_parts(spark, str(tmp_path / "in"), "fn", lines=True)
    got = sorted((r.ordinal, r.key) for r in entries.collect())
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert sorted((r.file.rpartition("/")[2], r.place, r.text) for r in bad.collect()) == [
        ("a.json", 3, "{broken"), ("a.json", 5, "null"), ("b.json", 1, '"text"'),
    ]
    with pytest.raises(Exception, match="(?i)malformed feed: .*a.json, place"):
        feeds.read_feed(spark, str(tmp_path / "in"), "fn", lines=True).collect()


def test_a_hot_key_is_merged_once(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(3000)]
    merged = recipes.merge_feeds(feed(spark, "ar", rows[:1500]), feed(spark, "epi", rows[1500:]))
    hot = merged.where("key = 'hot'").collect()
    assert [(r.recipe.title, r.feed_rank, r.ordinal) for r in hot] == [("2997", 0, 0)]
    assert merged.count() == 2001


def test_recipes_in_one_array(spark, tmp_path):
    data = [{"id": 1, "source": "ar", "title": "t", "ingredients": ["x"], "instructions": "a\nb"}]
    (tmp_path / "all.json").write_text(json.dumps(data, indent=4))
    got = tables.read_recipes(spark, str(tmp_path / "all.json"), one_array=True)
    assert rows(got) == [(1, "ar", "t", ["x"], "a\nb")]


def test_null_members_are_rejects(spark):
    good, bad = feeds.split_rejects(feed(spark, "ar", [("a", 1), ("b", None)]))
    assert [r.key for r in good.collect()] == ["a"] and [r.key for r in bad.collect()] == ["b"]


def test_defaults(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), (0, "s", "t", [], "i"), (5, "s", "t", ["x"], "i")], SCHEMA
    )
    got = rows(recipes.load_recipes(df))
    assert got == [(-1, "", "", [], ""), (-1, "s", "t", [], "i"), (5, "s", "t", ["x"], "i")]


def recipe_table(spark, ids):
    return spark.createDataFrame([(i, "s", f"t{i}", ["x"], "i") for i in ids], SCHEMA)


def test_update_ignores_unknown_ids_and_takes_the_last(spark):
    updates = spark.createDataFrame(
        [(2, "u", "first", ["y"], None, 1), (2, "u", "last", ["z"], None, 2), (9, "u", "n", [], "", 1)],
        "id long, source string, title string, ingredients array<string>, instructions string, seq int",
    )
    got = rows(recipes.update_matched(recipe_table(spark, [1, 2]), updates, "seq"))
    assert got == [(1, "s", "t1", ["x"], "i"), (2, "u", "last", ["z"], None)]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Joins as they are between tables too large to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plain = recipes.lookup
    monkeypatch.setattr(recipes, "lookup", lambda facts, table, on: plain(facts, table, on, max_bytes=0))
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges_above(plan, table):
    """Whether a scan of ``table`` lies below an exchange in an executed plan's text."""
    lines = plan.splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for i, line in enumerate(lines):
        if table in line and "FileScan" in line:
            level, above = depth(line), False
            for other in reversed(lines[:i]):
                if depth(other) < level:
                    level, above = depth(other), above or "Exchange" in other
            found.append(above)
    assert found
    return any(found)


def test_tables_laid_out_by_id_are_not_shuffled(spark, tmp_path, no_broadcast):
    path = str(tmp_path / "recipes")
    tables.replace_bucketed(recipe_table(spark, [-1, -1, *range(1, 200)]).repartition(3), path, buckets=8)
    target = tables.read_bucketed(spark, path, buckets=8)
    updates = spark.createDataFrame([(i, "u", f"new{i}", ["y"], "j") for i in range(0, 400, 7)], SCHEMA)
    updated = recipes.update_matched(target, updates)
    gone = recipes.delete_by_id(target, spark.createDataFrame([(5,), (6,), (900,)], "id long"))
    upserted = logs.upsert_results(target, recipe_table(spark, [3, 1000]), "id")
    for changed in (updated, gone, upserted):
        plan = changed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert not exchanges_above(plan, "bucketed_")
    assert exchanges_above(target.groupBy("title").count()._jdf.queryExecution().executedPlan().toString(), "bucketed_")
    assert tables.replace_bucketed(updated, path, buckets=8, dealt=True) == 2
    after = tables.read_bucketed(spark, path, buckets=8)
    assert {r.id: r.title for r in after.collect()} == {
        i: f"new{i}" if i % 7 == 0 else f"t{i}" for i in [-1, *range(1, 200)]
    }
    assert after.count() == 201 and sorted(r.id for r in gone.collect())[:6] == [-1, -1, 1, 2, 3, 4]
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # one partition per file
    assert after.where("title = 'x'").rdd.getNumPartitions() >= 8
    assert after.where("id = 77").rdd.getNumPartitions() < after.where("title = 'x'").rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert recipes.get_recipe(after, 77).first().title == "new77"
    with pytest.raises(FileNotFoundError):
        tables.read_bucketed(spark, str(tmp_path / "none"))


def test_delete(spark):
    table = recipe_table(spark, [1, 2, 3])
    left = recipes.delete_by_id(table, spark.createDataFrame([(2,), (7,)], "id long"))
    assert sorted(r.id for r in left.collect()) == [1, 3]
    with pytest.raises(ValueError):
        recipes.delete_by_id(table, spark.createDataFrame([(-1,)], "id long"))


def test_point_lookup(spark):
    table = recipe_table(spark, [1, 2])
    assert recipes.get_recipe(table, 2).first().title == "t2"
    with pytest.raises(ValueError):
        recipes.get_recipe(table, 3)


def test_replace_table_from_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    tables.replace_table(recipe_table(spark, range(1, 5)), path)
    tables.replace_table(tables.read_table(spark, path).where("id > 2"), path)
    assert sorted(r.id for r in tables.read_table(spark, path).collect()) == [3, 4]
    assert tables.table_versions(spark, path) == [1, 2]


def test_unfinished_version_is_invisible(spark, tmp_path):
    path = tmp_path / "table"
    tables.replace_table(recipe_table(spark, [1]), str(path))
    (path / "data-unfinished").mkdir()
    (path / "_version=2").touch()  # claimed, not yet written
    assert tables.read_table(spark, str(path)).count() == 1


def test_writers_of_one_table_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "table")
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda i: tables.replace_table(recipe_table(spark, [i]), path), range(1, 5)))
    assert sorted(done) == tables.table_versions(spark, path) == [1, 2, 3, 4]
    kept = [spark.read.parquet(tables.version_folder(spark, path, v)).first().id for v in done]
    assert kept == [1, 2, 3, 4]


def test_json_round_trip(spark, tmp_path):
    table = recipe_table(spark, range(1, 4))
    tables.write_recipes(table, str(tmp_path / "out"))
    assert rows(tables.read_recipes(spark, str(tmp_path / "out"))) == rows(table)


def test_incomplete_recipes_and_report(spark):
    df = spark.createDataFrame(
        [(1, "s", "½", ["x"], "i"), (2, "s", "t", [" ADVERTISEMENT "], "i"),
         (3, "s", "t", ["½"], "i"), (4, "s", "t", ["x"], "<a>b</a>")], SCHEMA,
    )
    cleaned = recipes.clean_recipes(df)
    assert [(r.id, r.ingredients) for r in recipes.drop_incomplete(cleaned).collect()] == [(3, [""])]
    assert tuple(recipes.cleaning_report(cleaned).first()) == (4, 1)


def test_prompt_texts(spark):
    df = spark.createDataFrame([(1, "s", "Pie", ["x"], "go")], SCHEMA)
    text = recipes.finetune_text(df).first().text
    assert text == (
        "Write a recipe for the following dish:  Pie\n\n"
        "Title: Pie\n\nIngredients:\n- x\n\nInstructions: go"
    )
    asked = df.select(F.lit("\n Pie　").alias("message"))
    assert recipes.chat_prompt(asked).first().prompt == "Write a recipe for the following dish: Pie"


def test_corpus_split_folders(spark, tmp_path):
    path = str(tmp_path / "corpus")
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "doc_id long, text string, split string")
    df.write.partitionBy("split").parquet(path)
    assert rows(tables.read_corpus(spark, path, split="val")) == [(2, "b")]
    assert tables.read_corpus(spark, path, streaming=True, split="train").isStreaming


def test_buckets_grow_with_the_input(spark, tmp_path):
    path = str(tmp_path / "in")
    recipe_table(spark, range(1, 100)).write.parquet(path)
    size = sum(file.stat().st_size for file in (tmp_path / "in").iterdir() if not file.name.startswith("."))
    found = tables.buckets_for(spark, path, least=8, bucket_bytes=100)
    assert found >= size // 100 > 8
    assert tables.buckets_for(spark, path, least=8) == 8
    tables.replace_bucketed(recipe_table(spark, range(1, 100)), str(tmp_path / "out"), buckets=found)
    after = tables.read_bucketed(spark, str(tmp_path / "out"), buckets=found)
    assert sorted(r.id for r in after.collect()) == list(range(1, 100))


def test_an_object_of_one_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task reads or writes all of it."""
    from millrace.plans import recipe_queries

    docs = tmp_path / "documents.parquet"
    text = F.concat(F.lit('"a" } {.'), F.col("id").cast("string"), F.lit("\nb"))
    rows = spark.range(3000).select((F.col("id") * 3).alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    rows.write.parquet(str(docs))
    joined = []

    def join(spark, folder, path):
        parts = sorted(Path(folder.removeprefix("file:")).glob("part-*"))
        sizes, whole = [p.stat().st_size for p in parts], b"".join(p.read_bytes() for p in parts)
        scratch.join_files(spark, folder, path)
        made = [p.read_bytes() for p in Path(path.removeprefix("file:")).glob("part-*")]
        joined.append((sizes, made == [whole] or not any(sizes) and not any(made)))

    monkeypatch.setattr(feeds, "join_files", join)
    got = recipe_queries.read_object_feed(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.source, r.ordinal, r.key, r.title) for r in got] == [
        ("ar", i, str(i * 3 // 4), '"a" } {') for i in range(3000)
    ]
    assert all(same for _, same in joined) and len(joined) == 3
    assert max(joined[0][0]) < sum(joined[0][0]) / 4


@pytest.mark.parametrize("local", [True, False])
def test_joined_files_keep_their_order(spark, tmp_path, monkeypatch, local):
    folder, path = tmp_path / "parts", tmp_path / "whole"
    folder.mkdir()
    path.mkdir()
    for i, lines in enumerate([["z", "a"], [], ["b"] * 3 + ["c"], ["a"]]):
        (folder / f"part-0000{i}-x.txt").write_text("".join(f"{line}\n" for line in lines))
    if not local:  # a store whose files have one writer each
        class Store:
            def __init__(self, fs):
                self.listStatus = fs.listStatus

            def getUri(self):
                return self

            def getScheme(self):
                return "store"

        found = scratch.hadoop_path
        monkeypatch.setattr(scratch, "hadoop_path", lambda *a: (Store(found(*a)[0]), found(*a)[1]))
    scratch.join_files(spark, str(folder), str(path))
    (whole,) = path.glob("part-*")
    assert whole.read_text() == "z\na\nb\nb\nb\nc\na\n"
