"""Url filters, quality rules, toxicity, line dedup and decontamination."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, line_spread, quality_rules, queries, sql, toxicity, trees, url_filters
from millrace.llm.components import components

from .conftest import order, pairs, words


def link(target):
    return f'<html><head><LINK href="{target}" rel="canonical"></head>'


def refresh(target):
    return f'<meta http-equiv=refresh content="0; url={target}">'


PAGES = [
    (1, "http://A.example.com/en/x?q=1#f", None),
    (2, "http://z.org/a", link("http://a.example.com/en/x?q=1")),
    (3, "https://z.org/b", refresh("/a")),
    (4, "http://www.example.com/en/p", link("//z.org/b")),
    (5, "http://q.org/d/e", link("f")),
    (6, "http://q.org/d/f", link("http://k.net/es/1")),
    (7, None, None),
    (8, "nohost", link("http://k.net/es/1")),
    (9, "http://x.com", "x"),
    (9, "http://x.com", "x"),
    (10, "http://y.org?x#y://", link("#top")),
    (11, "http://h.org/r", link("http://h.org/a?b=1&amp;c=2")),
    (None, "http://example.com/en/", ""),
]


@pytest.fixture(scope="module")
def page_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    df.write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_urls_equal_the_sql(spark, page_folder):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{page_folder}/pages.parquet/*.parquet')")
    expected = db.execute(sql.URLS).fetchall()
    found = [tuple(r) for r in queries.op1_url_filters(spark, page_folder).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def test_blocks_spread_to_aliases_but_not_over_allowed_urls(spark, page_folder):
    rows = queries.op1_url_filters(spark, page_folder).collect()
    verdict = {r.page_id: (r.verdict, r.rule) for r in rows}
    assert verdict[1] == ("block", "example.com/en/")
    assert verdict[2] == verdict[3] == verdict[5] == verdict[6] == ("block", None)
    assert verdict[4] == ("allow", "www.example.com/en/")
    assert verdict[7] == verdict[8] == verdict[9] == verdict[10] == verdict[11] == ("allow", None)


def test_redirect_tables_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", None)], "page_id long, url string, html string")
    hops = spark.createDataFrame(
        [("http://a.org/1", "http://b.org/2"), ("http://b.org/2", "http://c.net/es/"), (None, "x")],
        "source string, target string",
    )
    judged = url_filters.judge_urls(pages, queries.RULES, hops).collect()
    assert [(r.page_id, r.verdict, r.alias_blocked) for r in judged] == [(1, "block", True)]
    assert url_filters.judge_urls(pages.limit(0), queries.RULES, hops).collect() == []


def test_a_rule_given_twice_allows_and_long_urls_are_judged(spark):
    long_path = "x/" * 200_000
    urls = ["http://a.org/x/1", "http://b.org/" + long_path, "http://" + "s." * 300 + "c.org/y", "http://c.org/", None, "nohost"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    both = [("allow", "a.org/x/"), ("block", "a.org/x/"), ("block", "b.org/x/x/"), ("block", "c.org/y")]
    for rules in (both, both[::-1]):
        verdicts = {r.page_id: (r.verdict, r.rule) for r in url_filters.judge_urls(pages, rules).collect()}
        assert verdicts == {
            0: ("allow", "a.org/x/"), 1: ("block", "b.org/x/x/"), 2: ("block", "c.org/y"), 3: ("allow", None),
            4: ("allow", None), 5: ("allow", None),
        }


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (160, 159), (159, 160)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 161)}}


def brute_statistics(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, repeated, len(covered), failed


def judged(df, forest):
    return sorted((order(r.doc_id), *r[1:7]) for r in quality_rules.judge(df, forest).collect())


def test_statistics_equal_brute_force(odd_rows, small_documents):
    forest = trees.constant(1.0)
    for df in (odd_rows, small_documents):
        expected = sorted((order(i), *brute_statistics(t)) for i, t in pairs(df))
        assert judged(df, forest) == expected
    assert judged(odd_rows.limit(0), forest) == []


def test_trees_learn_and_keep_their_constraints():
    random = np.random.default_rng(1)
    x = random.normal(size=(4000, 3))
    y = ((x[:, 0] + 0.5 * np.sin(3 * x[:, 1]) + 0.3 * random.normal(size=4000)) > 0).astype(float)
    forest = trees.fit(x, y, np.array([1, 0, -1]))
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    for feature, sign in ((0, 1), (2, -1)):
        moved = x.copy()
        moved[:, feature] += 0.7
        assert (sign * (forest.margin(moved) - forest.margin(x)) >= -1e-9).all()


def test_flat_scoring_equals_a_walk_from_node_to_node():
    random = np.random.default_rng(2)
    x = np.round(random.normal(size=(1500, 4)), 1)  # many values on a threshold
    y = (x[:, 0] * x[:, 1] + random.normal(size=1500) > 0).astype(float)
    forest = trees.fit(x, y, np.array([0, 1, -1, 0]))
    for row, margin, score in zip(x[:200], forest.margin(x[:200]), forest.score(x[:200])):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                goes_left = row[forest.feature[node]] <= forest.threshold[node]
                node = (forest.left if goes_left else forest.right)[node]
            total += forest.value[node]
        assert abs(total - margin) < 1e-9 and abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_a_repeated_id_teaches_the_rules_once(small_documents, tiny, spark):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    one = quality_rules.labelled_features(small_documents, labels, 50)
    many = small_documents.select("doc_id", "text")
    for _ in range(4):
        many = many.union(many)
    again = quality_rules.labelled_features(many, labels, 50)
    assert len(one[1]) == 50 and all((a == b).all() for a, b in zip(one, again))


def test_trees_tell_junk_from_prose_and_survive_odd_labels(spark, tiny, small_documents):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    forest = quality_rules.fit_rules(small_documents, labels)
    scored = quality_rules.judge(small_documents, forest).join(labels, "doc_id").collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.9
    kept = {r.doc_id for r in scored if r.kept}
    good = quality_rules.keep_good(small_documents, forest)
    assert good.columns == small_documents.columns
    assert kept <= {r.doc_id for r in good.collect()}
    odd = spark.createDataFrame([(None, 1), (-5, 0), (1, None)], "doc_id long, quality int")
    assert quality_rules.fit_rules(small_documents, odd).score(np.zeros((1, 12)))[0] > 0.99
    assert not len(quality_rules.fit_rules(small_documents.limit(0), labels).roots)


def test_toxic_words_and_their_misspellings_are_scored(spark):
    random = np.random.default_rng(3)
    plain = ["".join(random.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = list(random.choice(plain, int(random.integers(20, 60))))
        if i % 3 == 0:
            text.insert(int(random.integers(0, 20)), "stinkbrain" if i % 2 else "wortless")
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 3 == 0)))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents, known)
    new = [(10_000, "abcde " * 4000 + "stinkbrainz " + "fghij " * 4000), (10_001, " ".join(plain)), (10_002, ""), (10_003, None)]
    scored = toxicity.score_toxicity(documents.union(spark.createDataFrame(new, documents.schema)), model)
    score = {r.doc_id: (r.score, r.predicted) for r in scored.collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([score[i][1] == (i % 3 == 0) for i in held]) > 0.95
    assert score[10_000][1] == 1 and score[10_001][1] == 0
    assert score[10_002] == score[10_003] and score[10_002][1] == 0
    assert all(0 <= s <= 1 for s, _ in score.values())


def test_folded_scores_equal_embeddings_and_softmax(spark):
    """A text of at most a passage, by its words' n-grams, vectors, average and softmax."""
    random = np.random.default_rng(4)
    table = random.normal(size=(toxicity.DIMENSION, toxicity.BUCKETS)).astype(np.float32)
    softmax, bias = random.normal(size=(toxicity.DIMENSION, 2)), random.normal(size=2)
    model = toxicity.fold(table, softmax, bias)

    def bucket(text, opens=False):
        codes = toxicity.LOWER_CODE[np.frombuffer(text, np.uint8)]
        hashed = toxicity.SpanHash(codes).of(np.array([0]), np.array([len(text)]))
        if opens:
            hashed = toxicity.mix(hashed ^ np.uint64(0xA5A5A5A5))
        return int(hashed[0] & np.uint64(toxicity.BUCKETS - 1))

    def passage(text_words):
        vectors = []
        for word in text_words:
            word = word.encode().lower()
            grams = [bucket(word)]
            for n in toxicity.GRAMS:
                grams += [bucket(word[i : i + n]) for i in range(len(word) - n + 1)]
                grams += [bucket(word[:n], opens=True)] if len(word) >= n else []
            vectors.append(table[:, grams].mean(axis=1))
        e = np.exp(np.mean(vectors, axis=0) @ softmax + bias)
        return e[1] / e.sum()

    texts = ["x", "Some four plain words", "stinkbrain", "one two three four five sixsixsix seven", "a b c d e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    for i, text in enumerate(texts):
        w = text.split()
        worst = max(passage(w[k : k + toxicity.PASSAGE]) for k in range(max(1, len(w) - toxicity.PASSAGE + 1)))
        assert scored[i] == pytest.approx(worst, abs=1e-5)


def test_toxicity_without_labels_or_documents(spark, odd_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd_rows, none)
    assert {r.predicted for r in toxicity.score_toxicity(odd_rows, model).collect()} == {0}
    assert toxicity.score_toxicity(odd_rows.limit(0), model).collect() == []


def brute_lines(rows, min_sites):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            sites.setdefault(line, set()).add(site or "")
    for doc_id, text, _ in rows:
        lines = (text or "").split("\n")
        hit = [bool(words(x)) and len(sites[x]) >= min_sites for x in lines]
        kept = "\n".join(x for x, h in zip(lines, hit) if not h) if any(hit) else text
        yield order(doc_id), 0 if text is None else len(lines), sum(hit), kept


@pytest.mark.parametrize("near", [0.25, 10.0])
def test_shared_lines_equal_brute_force(spark, odd_rows, near):
    """By estimates, and with every line near the threshold, by exact counts."""
    rows = [(i, f"menu | home\n{'own text %d ' % i * (i % 4)}\ncopyright notice {i % 3}", f"site{i % (5 + i % 9)}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    df = df.unionByName(odd_rows.select(*df.columns))
    expected = list(brute_lines([(r.doc_id, r.text, r.source) for r in df.collect()], 6))
    assert any(e[2] for e in expected)
    found = line_spread.marked_documents(df, min_sites=6, near=near).collect()
    assert sorted(map(repr, expected)) == sorted(repr((order(r.doc.doc_id), r.n_lines, r.n_removed, r.clean)) for r in found)


def test_removing_lines_keeps_columns_and_counts(odd_rows):
    cleaned = line_spread.remove_boilerplate(odd_rows, min_sites=2)
    assert cleaned.dtypes == odd_rows.dtypes and cleaned.count() == odd_rows.count()
    assert line_spread.remove_boilerplate(odd_rows.limit(0)).count() == 0


def test_documents_of_mostly_shared_lines_lose_them_too(spark):
    rows = [(i, "menu and home of all sites\nown", f"s{i}", 30) for i in range(5)] + [(9, "menu and home of all sites", "s9", 26)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    cleaned = line_spread.remove_boilerplate(df.where("doc_id > 0"), min_sites=5).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in cleaned) == [(i, "own", 3) for i in range(1, 5)] + [(9, "", 0)]


ITEMS = [
    (0, "Anna buys 12 apples for $3.50 each at the market and then Anna walks 5 km home before dinner with Tom."),
    (1, None), (2, ""), (3, "too short"),
]
LEAKS = [
    (1, "x y z Maria buys 40 apples for $9 each at the market and then Maria walks 7.5 km home before dinner with Jim. more text"),
    (2, "Maria buys 40 apples for $9 each at the market and then Peter walks 7 km home before dinner with Jim"),
    (3, "Anna buys 12 pears for a friend who lives 5 km from the market and then goes to dinner"),
    (None, ITEMS[0][1]), (4, None), (5, ""), (6, "too short"), (1, "another text of document one"),
]


@pytest.mark.parametrize("broadcast_rows", [0, 2**18])
def test_reparameterised_items_are_found(spark, broadcast_rows):
    documents = spark.createDataFrame(LEAKS, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hash", F.lit(1))
    found = decontamination.find_leaks(documents, items, broadcast_rows=broadcast_rows).collect()
    # Document 2 gives one name of the item two names; document 3 is another sentence.
    assert {(r.doc_id, r.item_id, r.n_changed > 0) for r in found} == {(1, 0, True), (None, 0, False)}
    left = decontamination.drop_leaking(documents, items)
    assert left.columns == documents.columns
    assert sorted((order(r.doc_id), r.text) for r in left.collect() if r.text) == sorted(
        [(2, LEAKS[1][1]), (3, LEAKS[2][1]), (6, "too short"), (1, LEAKS[-1][1])]
    )
    assert decontamination.find_leaks(documents.limit(0), items).count() == 0
    assert decontamination.find_leaks(documents, items.limit(0)).count() == 0


def test_given_documents_that_hold_an_item(spark, tiny, small_documents):
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    expected = {(i, b.item_id) for b in items.collect() for i, t in pairs(small_documents) if b.text in t}
    found = decontamination.find_leaks(small_documents, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


def found_leaks(spark, texts, items, **settings):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontamination.find_leaks(documents, table, **settings).collect()}


@pytest.mark.parametrize("broadcast_rows", [0, 2**18])
def test_attached_units_and_signs_are_typed_units(spark, broadcast_rows):
    item = "a train that runs 5 km in rain needs 5 % more fuel and costs the firm $20 a day on top of it"
    texts = [
        "a train that runs 7km in rain needs 7 percent more fuel and costs the firm 30 € a day on top of it",
        "a train that runs 7 km in rain needs 7% more fuel and costs the firm £30 a day on top of it",
    ]
    assert found_leaks(spark, texts[1:], [item], broadcast_rows=broadcast_rows) == {(0, 0)}
    assert found_leaks(spark, [texts[0].replace("30 €", "€30")], [item], broadcast_rows=broadcast_rows) == {(0, 0)}
    values = spark.createDataFrame([("7km 5 % €3 4£ h2o 5th 100% $ x%y",)], "t string")
    tokens = F.filter(decontamination.raw_tokens(F.col("t")), lambda t: t != "")
    rows = values.select(tokens.alias("t")).select(decontamination.valued_window(F.col("t"), F.lit(0), 13).alias("v"))
    assert rows.first().v == [
        "§n:7", "§u:km", "§n:5", "§u:%", "§u:€", "§n:3", "§n:4", "§u:£", "h2o", "5th", "§n:100", "§u:%", "x",
    ]


def test_one_unsteady_value_costs_only_its_windows(spark):
    item = "a shop sold 5 apples to every single guest who had come by bus or on foot from the old town over the hill and 5 km away"
    text = item.replace("5 apples", "7 apples").replace("5 km", "9 km")
    assert found_leaks(spark, [text], [item]) == {(0, 0)}
    item = "The shop opens at nine in the morning and sells bread to all. The baker sleeps until it is dark outside again."
    text = item.replace("The baker", "Our baker")
    assert found_leaks(spark, [text], [item]) == {(0, 0)}


def test_names_of_several_words_are_one_name(spark):
    item = "we saw Anna walk to the shop and then Anna paid for the bread that Anna ate on the way"
    assert found_leaks(spark, [item.replace("Anna", "Eva Maria Braun")], [item]) == {(0, 0)}


ITEM = (
    "When the old miller came back from town he found that the water had run dry and nobody could tell him "
    "why the big wheel still turned slowly through each night without any grain or flour left inside"
)


@pytest.mark.parametrize("broadcast_rows", [0, 2**18])
def test_edited_cut_and_recased_items_are_found(spark, broadcast_rows):
    every = ITEM.split(" ")
    texts = [
        " ".join("zzz" if i % 10 == 5 else w for i, w in enumerate(every)),
        " ".join(every[:20]),
        ITEM.upper(),
        ITEM.lower(),
        " ".join(every[:12]),
        " ".join(w if i % 5 else "zzz" for i, w in enumerate(every)),
    ]
    assert found_leaks(spark, texts, [ITEM], broadcast_rows=broadcast_rows) == {(0, 0), (1, 0), (2, 0), (3, 0)}
    items = [
        "one edit in the middle of a short item leaves no window of eight tokens",
        "seven blue cats sleep",
        "Anna Berta Clara 1 2 3 4 5 6 7 8",
    ]
    texts = [
        "one edit in the middle of some short item leaves no window of eight tokens",
        "it says that seven blue cats sleep here",
        "Anna Berta Clara 1 2 3 4 5 6 7 8",
        "seven blue dogs sleep",
    ]
    assert found_leaks(spark, texts, items, broadcast_rows=broadcast_rows) == {(0, 0), (1, 1), (2, 2)}
