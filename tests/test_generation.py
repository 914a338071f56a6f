import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import generation as G


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


def filtered(logits, temperature=1.0, top_k=-1, top_p=1.0):
    """Probabilities per token id after all filters, by numpy."""
    x = np.asarray(logits, dtype="float64")
    if temperature != 1.0:
        x = x / max(temperature, 1e-5)
    if top_k > 0:
        x = np.where(x < np.sort(x)[::-1][min(top_k, len(x)) - 1], -np.inf, x)
    if top_p < 1.0:
        order = np.lexsort((np.arange(len(x)), -x))
        before = np.concatenate([[0.0], np.cumsum(softmax(x)[order])[:-1]])
        drop = order[(before > top_p) & (np.arange(len(x)) > 0)]
        x[drop] = -np.inf
    return softmax(x)


def kept(spark, logits, **settings):
    df = spark.createDataFrame([(logits,)], "logits array<float>")
    probs = {p.token_id: p.prob for p in G.filter_logits(df, **settings).first().probs}
    return [probs.get(i, 0.0) for i in range(len(logits))]


@pytest.mark.parametrize(
    "settings, expected",
    [
        ({"top_k": 2}, [0.576117, 0.211942, 0.211942, 0]),
        ({"top_p": 0.6}, [0.731059, 0.268941, 0, 0]),
        ({"temperature": 0.5, "top_k": 3, "top_p": 0.85}, [0.880797, 0.119203, 0, 0]),
    ],
)
def test_known_filters(spark, settings, expected):
    assert kept(spark, [2.0, 1.0, 1.0, 0.0], **settings) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(
    "settings", [{}, {"temperature": 0.0, "top_p": 0.9}, {"top_k": 500}, {"top_k": 7, "top_p": 0.3},
                 {"temperature": 2.0, "top_k": 40, "top_p": 0.95}, {"top_p": 0.0}],
)
def test_filters_against_numpy(spark, settings):
    rng = np.random.default_rng(4)
    for _ in range(3):
        logits = rng.normal(size=200).astype("float32").round(1).tolist()
        assert kept(spark, logits, **settings) == pytest.approx(filtered(logits, **settings), abs=1e-9)


def test_settings_from_columns(spark):
    df = spark.createDataFrame(
        [([2.0, 1.0, 1.0, 0.0], 1.0, 2, 1.0), ([2.0, 1.0, 1.0, 0.0], 1.0, -1, 0.6)],
        "logits array<float>, t double, k int, p double",
    )
    rows = G.filter_logits(df, "logits", F.col("t"), F.col("k"), F.col("p")).collect()
    assert [len(r.probs) for r in rows] == [3, 2]


def test_logits_from_a_long_table(spark):
    wide = spark.createDataFrame([(1, [2.0, 1.0, 1.0, 0.0])], "ctx_id long, logits array<float>")
    long = wide.select("ctx_id", F.posexplode("logits").alias("token_id", "logit")).repartition(3)
    got = G.filter_logits(G.gather_logits(long), "candidates", top_k=2).first().probs
    assert got == G.filter_logits(wide, top_k=2).first().probs


def uniform(*parts):
    text = ":".join(map(str, parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def test_draws_follow_the_cumulative_sum(spark):
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(300, 150)).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(logits)], "ctx long, logits array<double>")
    drawn = G.draw_token(G.filter_logits(df, top_p=0.9), 5, "ctx").collect()
    for row in drawn:
        probs = filtered(logits[row.ctx], top_p=0.9)
        order = [i for i in np.lexsort((np.arange(150), -logits[row.ctx])) if probs[i] > 0]
        sums = np.cumsum(probs[order])
        u = uniform(5, row.ctx)
        assert row.token_id == next((order[i] for i, s in enumerate(sums) if s > u), order[-1])


def documents(seed=8, count=60, eos=12):
    rng = random.Random(seed)
    return [[rng.choice([0, 0, 0, *range(12)]) for _ in range(rng.randint(1, 30))] + [eos] for _ in range(count)]


def counts(docs):
    model = defaultdict(Counter)
    for ids in docs:
        for prev, following in zip(ids, ids[1:]):
            model[prev][following] += 1
    return model


def table(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, input_ids array<int>")


def test_model_and_scores(spark):
    docs, held_out = documents(), [[0, 3, 99, 5], [1], [99, 0]]
    model = counts(docs)
    built = G.train_ngram_model(table(spark, docs))
    assert {(r.prev, r.next): r.n for r in built.collect()} == {
        (p, q): n for p, following in model.items() for q, n in following.items()
    }
    got = {r.doc_id: r for r in G.score_ngram(table(spark, held_out), built, 100, ["doc_id"]).collect()}
    for i, ids in enumerate(held_out):
        loss, hits = 0.0, 0
        for p, q in zip(ids, ids[1:]):
            loss -= math.log((model[p][q] + 1) / (sum(model[p].values()) + 100))
            best = min(model[p], key=lambda t: (-model[p][t], t)) if model[p] else 0
            hits += best == q
        if len(ids) > 1:
            assert got[i].loss_sum == pytest.approx(loss) and got[i].correct == hits
            assert got[i].total == len(ids) - 1
    assert set(got) == {0, 2}


def test_scores_are_causal(spark):
    built = G.train_ngram_model(table(spark, documents()))
    first, second = [0, 1, 2, 3], [0, 1, 2, 7]
    rows = table(spark, [first[:3], second[:3]])
    a, b = sorted(G.score_ngram(rows, built, 13, ["doc_id"]).collect())
    assert a.loss_sum == b.loss_sum


def complete(model, ids, key, seed, limit, eos):
    last, out = ids[-1], []
    for step in range(limit):
        following = sorted(model[last].items(), key=lambda t: (-t[1], t[0])) if last in model else []
        token, u, sum_ = eos, uniform(seed, key, step), 0.0
        for candidate, n in following:
            sum_ += n / sum(model[last].values())
            token = candidate
            if sum_ > u:
                break
        out.append(token)
        if token == eos or len(ids) + len(out) >= 512:
            break
        last = token
    return out


@pytest.mark.parametrize("bounds", [{}, {"max_bytes": 0}])
@pytest.mark.parametrize("greedy", [True, False])
def test_completion_against_a_loop(spark, greedy, bounds):
    docs = documents()
    model = counts(docs)
    if greedy:
        model = {p: Counter({min(c, key=lambda t: (-c[t], t)): 1}) for p, c in model.items()}
    prompts = [[0, 1], [5], [99], [3, 3, 4], [1] * 505]
    df = spark.createDataFrame(list(enumerate(prompts)), "prompt_id long, input_ids array<int>")
    got = G.complete_prompts(
        df, G.train_ngram_model(table(spark, docs)), eos=12, max_tokens=11, seed=3,
        top_p=0.0 if greedy else 1.0, cut_every=4, **bounds,
    )
    assert {r.prompt_id: r.output_ids for r in got.collect()} == {
        i: complete(model, ids, i, 3, 11, 12) for i, ids in enumerate(prompts)
    }


@pytest.mark.parametrize("bounds", [{}, {"max_bytes": 0}])
def test_requests_bring_their_own_settings(spark, bounds):
    """Also a prompt without tokens, which is answered by nothing."""
    docs = documents()
    model = counts(docs)
    greedy = {p: Counter({min(c, key=lambda t: (-c[t], t)): 1}) for p, c in model.items()}
    rows = [(0, [0, 1], 0.0, 5), (1, [0, 1], 1.0, 7), (2, [5], None, 3), (3, [], 0.0, 4), (4, [3], 0.0, 0)]
    df = spark.createDataFrame(rows, "prompt_id long, input_ids array<int>, nucleus double, most int")
    got = G.complete_prompts(
        df, G.train_ngram_model(table(spark, docs)), eos=12, max_tokens="most", top_p="nucleus", seed=3, **bounds
    )
    expected = {
        i: complete(greedy if p == 0.0 else model, ids, i, 3, most, 12) if ids else []
        for i, ids, p, most in rows
    }
    assert {r.prompt_id: r.output_ids for r in got.collect()} == expected


def test_large_tables_stay_where_they_are(spark, monkeypatch):
    """Beyond the bound, prompts travel to the tables: no step shuffles them."""
    steps = []
    plain = G.next_step
    monkeypatch.setattr(G, "next_step", lambda *a: steps.append(plain(*a)) or steps[-1])
    tables = G.successors(G.train_ngram_model(table(spark, documents())))
    df = spark.createDataFrame([(i, [i % 12]) for i in range(50)], "prompt_id long, input_ids array<int>")
    G.complete_prompts(df, tables, 12, 4, max_bytes=0).collect()
    assert steps
    for step in steps:
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


SETTINGS = [
    {}, {"top_k": 3}, {"top_p": 0.5}, {"top_p": 0.0}, {"temperature": 0.3, "top_k": 5, "top_p": 0.9},
    {"temperature": 2.5}, {"temperature": 0.0}, {"top_k": 1}, {"temperature": 1.7, "top_p": 0.8}, {"temperature": 1e-7, "top_p": 0.9},
]


def test_ranks_follow_the_filtered_probabilities(spark):
    """Every successor is drawn by numbers that cover just its filtered probability."""
    model = counts(documents())
    model[50] = Counter({i: 1 + (i % 3) for i in range(40)})
    rows = [(p, following) for p, following in model.items()]
    tables = G.successors(spark.createDataFrame([(p, t, n) for p, f in rows for t, n in f.items()], "prev int, next int, n long"))
    ranked = {(r.prev, r.rank): r.token for r in tables.ranked.collect()}
    for prev, following in rows:
        order = sorted(following, key=lambda t: (-following[t], t))
        assert [ranked[prev, i + 1] for i in range(len(order))] == order
    grid = [(i + 0.5) / 4000 for i in range(4000)]
    numbers = spark.createDataFrame([(u,) for u in grid], "u double")
    for settings in SETTINGS:
        values = {"temperature": 1.0, "top_k": -1, "top_p": 1.0} | settings
        rank = G.choose_rank(F.col("levels"), F.col("u"), *[F.lit(v) for v in values.values()])
        drawn = numbers.crossJoin(F.broadcast(tables.levels)).groupBy("prev", rank.alias("rank")).count().collect()
        share = {(r.prev, ranked[r.prev, r.rank]): r["count"] / len(grid) for r in drawn}
        for prev, following in rows:
            logits = [math.log(following[t]) if following[t] else -math.inf for t in range(40)]
            probs = filtered(logits, **settings)
            for token, prob in enumerate(probs):
                assert share.get((prev, token), 0.0) == pytest.approx(prob, abs=1.01 / len(grid)), (settings, prev, token)


def test_any_number_of_settings_is_one_plan(spark):
    """A thousand temperatures: as many steps and joins as for one, each drawn by its own."""
    docs = documents()
    rng = random.Random(2)
    rows = [(i, [rng.randrange(12)], 0.2 + i / 500, rng.choice([-1, 2, 5]), rng.choice([0.0, 0.4, 1.0])) for i in range(1000)]
    df = spark.createDataFrame(rows, "prompt_id long, input_ids array<int>, t double, k int, p double")
    tables = G.successors(G.train_ngram_model(table(spark, docs)))
    many = G.complete_prompts(df, tables, 12, 3, temperature="t", top_k="k", top_p="p", seed=9)
    one = G.complete_prompts(df, tables, 12, 3, seed=9)
    joins = [x._jdf.queryExecution().optimizedPlan().toString().count("Join") for x in (many, one)]
    assert joins[0] == joins[1] <= 6
    model = counts(docs)
    for (i, ids, t, k, p), out in zip(rows, [r.output_ids for r in many.orderBy("prompt_id").collect()]):
        last = ids[-1]
        for step, token in enumerate(out):
            logits = [math.log(model[last][x]) if model[last][x] else -math.inf for x in range(13)]
            probs = filtered(logits, t, k, p)
            order = sorted((x for x in range(13) if probs[x] > 0), key=lambda x: (-probs[x], x))
            sums, u = np.cumsum(probs[order]), uniform(9, i, step)
            if np.abs(sums - u).min() > 1e-9:
                assert token == next((x for x, s in zip(order, sums) if s > u), order[-1])
            last = token
        assert len(out) == 3 or out[-1] == 12


PROMPTS = ["the first", "the second", "a third"]


def test_prompt_suite(spark):
    words = ["the", "cat", "sat", "on", "mat"]
    vocab = spark.createDataFrame([(w, 1, i) for i, w in enumerate(words)], "word string, n long, id int")
    ids = [0, 1, 2, 3, 0, 4, 5]
    model = G.train_ngram_model(table(spark, [ids]))
    prompts = spark.createDataFrame(
        [(i, p, [0]) for i, p in enumerate(PROMPTS)],
        "prompt_id long, input string, input_ids array<int>",
    )
    samples = spark.createDataFrame(
        [(i, [0]) for i in range(5)], "prompt_id long, input_ids array<int>"
    )
    known = spark.createDataFrame([("cat",), ("sat",), ("on",), ("the",)], "word string")
    scored, summary = G.evaluate_prompt_suite(
        7, prompts, samples, model, vocab, known, 5, 6, top_p=0.0
    )
    listed = scored.orderBy("prompt_id").collect()
    assert [p.input for p in listed] == PROMPTS
    assert {p.output for p in listed} == {"cat sat on the cat sat"}
    row = summary.first()
    assert row.step == 7 and row.avg_lexical_validity == 1.0
    assert row.avg_diversity == pytest.approx(1.0) and row.self_bleu == pytest.approx(1.0)
