"""Sampling from logits, next-token count models and prompt completion."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.logits import (
    Setting,
    choose_rank,
    draw,
    filter_candidates,
    from_dense,
    uniform,
)
from millrace.functions.tokens import bind
from millrace.operators.lookups import BROADCAST_BYTES, fits_broadcast, lookup
from millrace.operators.metrics import checkpoint_summary, text_diversity, lexical_validity
from millrace.operators.once import compute_once
from millrace.operators.positions import global_position
from millrace.operators.tokens import decode
from millrace.sources.scratch import cut_lineage, free_table

SETTINGS = {"temperature": 1.0, "top_k": -1, "top_p": 1.0}


def gather_logits(df: DataFrame, key: str = "ctx_id") -> DataFrame:
    """``(key, candidates)`` from a long table ``(key, token_id, logit)``.

    A context has at most one row per word of the vocabulary.
    """
    candidate = F.struct(
        F.col("token_id").cast("int").alias("token_id"), F.col("logit").cast("double").alias("logit")
    )
    return df.groupBy(key).agg(F.collect_list(candidate).alias("candidates"))


def filter_logits(
    df: DataFrame,
    logits: str = "logits",
    temperature: Setting = 1.0,
    top_k: Setting = -1,
    top_p: Setting = 1.0,
) -> DataFrame:
    """Add ``probs``: the kept tokens of each context with their probabilities.

    ``logits`` is a vector over the vocabulary, or ``candidates`` of a long table.
    Settings may be columns, for requests that bring their own.
    """
    dense = "struct" not in dict(df.dtypes)[logits]
    rows = from_dense(F.col(logits)) if dense else F.col(logits)
    kept = filter_candidates(rows, temperature, top_k, top_p)
    return df.withColumn("probs", kept)


def draw_token(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Add ``token_id``: one token per context, drawn by its probability."""
    u = uniform(seed, *[F.col(k) for k in keys])
    return df.withColumn("token_id", bind(F.col("probs"), lambda probs: draw(probs, u)))


def next_pairs(df: DataFrame, keep: list[str] | None = None, ids: str = "input_ids") -> DataFrame:
    """Rows ``(prev, next)`` of neighbouring tokens."""
    col = F.col(ids)
    count = F.greatest(F.size(col) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(col, 1, count).alias("prev"), F.slice(col, 2, count).alias("next"))
    return df.select(*(keep or []), F.inline(pairs)).toDF(*(keep or []), "prev", "next")


def train_ngram_model(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Next-token counts ``(prev, next, n)``."""
    return next_pairs(df, ids=ids).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))


def score_ngram(
    df: DataFrame,
    model: DataFrame,
    vocab_size: int,
    by: list[str] | None = None,
    ids: str = "input_ids",
) -> DataFrame:
    """Loss sum, hits and token count of held-out rows, with add-one smoothing.

    Equal pairs are counted before they meet the model, which should be a written
    table.  A token never seen before predicts id 0, the first of equally likely ones.
    """
    by = by or []
    pairs = next_pairs(df, by, ids).groupBy(*by, "prev", "next").agg(
        F.count(F.lit(1)).alias("times")
    )
    before = model.groupBy("prev").agg(
        F.sum("n").alias("total"),
        F.max(F.struct("n", (-F.col("next")).alias("rank"))).alias("best"),
    ).select("prev", "total", (-F.col("best.rank")).alias("best"))
    found = lookup(pairs, model, ["prev", "next"])
    found = lookup(found, cut_lineage(before, "totals"), ["prev"])
    prob = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + vocab_size)
    hit = F.coalesce("best", F.lit(0)) == F.col("next")
    return found.groupBy(*by).agg(
        F.sum(-F.ln(prob) * F.col("times")).alias("loss_sum"),
        F.sum(F.when(hit, F.col("times")).otherwise(0)).alias("correct"),
        F.sum("times").alias("total"),
    )


class Successors(NamedTuple):
    """A count model as two written tables.

    ``levels(prev, levels)`` has the distinct counts of what follows a token, each with the
    number of successors that have it and the first of their ranks; ``ranked(prev, rank,
    token)`` has the successors themselves.  No setting is part of either.
    """

    levels: DataFrame
    ranked: DataFrame


def successors(model: DataFrame) -> Successors:
    """The successors of every token, ranked by falling count, then by id.

    Ranks are positions by levels of count and id, so the successors of a very common
    token are spread over buckets.  The distinct counts of ``N`` occurrences are fewer
    than the square root of ``2 * N``, which bounds the arrays.
    """
    ranked = global_position(
        model.select("prev", "next", "n"),
        levels=[-F.floor(F.log2("n")), -F.col("n"), F.shiftright(F.col("next").cast("long"), 14)],
        order=[F.col("next")],
        name="rank",
        by=["prev"],
    )
    ranked = cut_lineage(ranked.select("prev", "rank", "n", F.col("next").alias("token")), "ranked")
    levels = ranked.groupBy("prev", "n").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("m"))
    level = F.struct("first", F.col("n").alias("n"), "m")
    levels = levels.groupBy("prev").agg(F.sort_array(F.collect_list(level)).alias("levels"))
    return Successors(cut_lineage(levels, "levels"), ranked.select("prev", "rank", "token"))


# Bytes of a prompt in a step's join, without what it has been answered so far.
STATE_BYTES = 64


def complete_prompts(
    prompts: DataFrame,
    model: DataFrame | Successors,
    eos: int,
    max_tokens: int | str = 512,
    temperature: float | str = 1.0,
    top_k: int | str = -1,
    top_p: float | str = 1.0,
    seed: int = 42,
    key: str = "prompt_id",
    cut_every: int = 8,
    context: int = 512,
    **bounds: int,
) -> DataFrame:
    """Extend ``prompts(key, input_ids)`` token by token: ``(key, output_ids)``.

    Settings may name columns of ``prompts``, for requests that bring their own (NULL: the
    default); they are part of each prompt's row, so the plan is the same for any number
    of them.  A prompt stops after the end token, at ``max_tokens`` new tokens or when
    prompt and answer fill the ``context``.  A token without successors is followed by the
    end token; a prompt without tokens is answered by nothing.  Keys must be unique.

    A step draws a rank from the levels of the last token, then looks the rank up: two
    joins with the written tables of ``successors``.  Tables measured within the bound are
    broadcast.  Larger ones stay where they are: the open prompts, of a measured number,
    are broadcast to them and the few matches back.  The state is written every
    ``cut_every`` steps (every step in the second case), the one before it deleted, and
    the loop ends once no prompt is open.
    """
    tables = model if isinstance(model, Successors) else successors(model)
    asked = {"temperature": temperature, "top_k": top_k, "top_p": top_p}
    values = {
        name: F.coalesce(F.col(value), F.lit(SETTINGS[name])) if isinstance(value, str) else F.lit(value)
        for name, value in asked.items()
    }
    most = F.col(max_tokens) if isinstance(max_tokens, str) else F.lit(max_tokens)
    state = prompts.select(
        key,
        values["temperature"].cast("double").alias("temperature"),
        values["top_k"].cast("long").alias("top_k"),
        values["top_p"].cast("double").alias("top_p"),
        most.cast("int").alias("most"),
        F.size("input_ids").alias("context"),
        F.when(most > 0, F.try_element_at("input_ids", F.lit(-1))).alias("last"),
        F.array().cast("array<int>").alias("output_ids"),
    )
    written = state = cut_lineage(state, "completion")
    near = all(fits_broadcast(table, **bounds) for table in tables)
    few = not near and state.count() * STATE_BYTES <= BROADCAST_BYTES
    for step in range(state.agg(F.max("most")).first()[0] or 0):
        if step and (few or step % cut_every == 0):
            state = cut_lineage(state, "completion")
            free_table(written)
            written = state
            if state.where("last is not null").isEmpty():
                break
        state = next_step(state, tables, eos, step, seed, key, context, near, few)
    return state.select(key, "output_ids")


def next_step(
    state: DataFrame, tables: Successors, eos: int, step: int, seed: int, key: str, context: int, near: bool, few: bool
) -> DataFrame:
    """The state after one more token of every open prompt."""
    asked = state.withColumn("_u", uniform(seed, F.col(key), F.lit(step)))
    rank = choose_rank(F.col("levels"), F.col("_u"), F.col("temperature"), F.col("top_k"), F.col("top_p"))
    levels = tables.levels.withColumnRenamed("prev", "_prev")
    ranked = tables.ranked.select(F.col("prev").alias("_before"), F.col("rank").alias("_place"), "token")
    follows, drawn = F.col("last") == F.col("_prev"), [F.col("last") == F.col("_before"), F.col("_rank") == F.col("_place")]
    if few:
        open_ = asked.where("last is not null").select(key, "last", "_u", "temperature", "top_k", "top_p")
        ranks = levels.join(F.broadcast(open_), follows).select(key, "last", rank.alias("_rank"))
        answers = ranked.join(F.broadcast(ranks), drawn).select(key, "token")
        found = asked.join(F.broadcast(answers), key, "left")
    else:
        if near:
            levels, ranked = F.broadcast(levels), F.broadcast(ranked)
        found = compute_once(asked.join(levels, follows, "left"), {"_rank": rank}).drop("levels").join(ranked, drawn, "left")
    is_open = F.col("last").isNotNull()
    grown = F.col("context") + is_open.cast("int")
    token = F.when(is_open, F.coalesce("token", F.lit(eos)))
    goes_on = (F.col("_token") != eos) & (F.col("_grown") < context) & (F.col("most") > step + 1)
    return found.withColumns({"_token": token, "_grown": grown}).select(
        key,
        "temperature",
        "top_k",
        "top_p",
        "most",
        F.col("_grown").alias("context"),
        F.when(goes_on, F.col("_token")).alias("last"),
        F.when(is_open, F.concat("output_ids", F.array("_token"))).otherwise(F.col("output_ids")).alias("output_ids"),
    )


def evaluate_prompt_suite(
    step: int,
    prompts: DataFrame,
    samples: DataFrame,
    model: DataFrame,
    vocab: DataFrame,
    dictionary: DataFrame,
    eos: int,
    max_tokens: int = 512,
    seed: int = 42,
    sample_seed: int = 43,
    **settings: float,
) -> tuple[DataFrame, DataFrame]:
    """The two result tables of one checkpoint (see ``evaluation_results``).

    ``prompts(prompt_id, input, input_ids)`` are completed and scored;
    ``samples(prompt_id, input_ids)`` repeat one prompt for self-BLEU.
    """

    tables = successors(model)

    def completed(rows: DataFrame, seed: int) -> DataFrame:
        out = complete_prompts(rows, tables, eos, max_tokens, seed=seed, **settings)
        texts = decode(out, vocab, "prompt_id", "output_ids")
        return texts.select(F.lit(step).alias("step"), "prompt_id", F.col("text").alias("output"))

    outputs = cut_lineage(completed(prompts, seed), "outputs")
    repeats = cut_lineage(completed(samples, sample_seed), "samples")
    return evaluation_results(
        outputs.join(prompts.select("prompt_id", "input"), "prompt_id"), repeats, dictionary
    )


def evaluation_results(
    outputs: DataFrame, samples: DataFrame, dictionary: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Result tables of completed prompts: one row per prompt, one row per step.

    ``(step, prompt_id, input, output, diversity, lexical_validity)`` and
    ``(step, avg_diversity, avg_lexical_validity, self_bleu)``.  They stay flat,
    so that a step may have any number of prompts.
    """
    key = ["step", "prompt_id"]
    valid = lexical_validity(outputs, dictionary, key, "output")
    scored = outputs.withColumn("diversity", text_diversity(F.col("output"))).join(valid, key)
    scored = scored.select(*key, "input", "output", "diversity", "lexical_validity")
    return scored, checkpoint_summary(outputs, samples, dictionary, key, "prompt_id")
