"""Logit filters and draws as array expressions: one row per context, no shuffle.

``candidates`` are ``array<struct<token_id int, logit double>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.tokens import IGNORE_INDEX, bind

Setting = float | int | Column


def as_column(setting: Setting) -> Column:
    return setting if isinstance(setting, Column) else F.lit(setting)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda sum, x: sum + x)


def row_loss(logits: Column, label: Column) -> tuple[Column, Column]:
    """Cross entropy of one row (NULL if ignored) and whether its label ranks first."""
    counted = label != IGNORE_INDEX

    def loss(top: Column) -> Column:
        scaled = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
        return top + F.ln(total(scaled)) - F.get(logits, label).cast("double")

    value = F.when(counted, bind(F.array_max(logits).cast("double"), loss))
    hit = counted & (F.array_position(logits, F.array_max(logits)) - 1 == label)
    return value, hit


def from_dense(logits: Column) -> Column:
    """Candidates of a full logit vector, whose indices are the token ids."""
    return F.transform(
        logits,
        lambda x, i: F.struct(i.cast("int").alias("token_id"), x.cast("double").alias("logit")),
    )


def filter_candidates(
    candidates: Column, temperature: Setting = 1.0, top_k: Setting = -1, top_p: Setting = 1.0
) -> Column:
    """Scale, keep the top k (ties kept) and the nucleus, renormalise.

    Result: ``array<struct<token_id int, prob double>>``, most probable first,
    equal ones by token id.
    """
    temperature, top_k, top_p = map(as_column, (temperature, top_k, top_p))
    divisor = F.when(temperature == 1.0, F.lit(1.0)).otherwise(
        F.greatest(temperature, F.lit(1e-5))
    )
    ordered = F.array_sort(
        F.transform(
            candidates,
            lambda c: F.struct((-(c["logit"] / divisor)).alias("cost"), c["token_id"].alias("token_id")),
        )
    )

    def top(sorted: Column) -> Column:
        last = F.get(sorted, F.least(top_k.cast("int"), F.size(sorted)) - 1)["cost"]
        kept = bind(last, lambda limit: F.filter(sorted, lambda c: c["cost"] <= limit))
        return F.when(top_k > 0, kept).otherwise(sorted)

    def weigh(sorted: Column) -> Column:
        least = F.get(sorted, F.lit(0))["cost"]
        return bind(
            least,
            lambda low: F.transform(
                sorted,
                lambda c: F.struct(c["token_id"].alias("token_id"), F.exp(low - c["cost"]).alias("weight")),
            ),
        )

    def nucleus(weights: Column) -> Column:
        # The limit rides in the accumulator, so it is computed once.
        start = F.struct(
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("kept"),
            (total(weights["weight"]) * top_p).alias("limit"),
        )
        count = F.aggregate(
            weights,
            start,
            lambda acc, w: F.struct(
                (acc["sum"] + w["weight"]).alias("sum"),
                (acc["kept"] + (acc["sum"] <= acc["limit"]).cast("int")).alias("kept"),
                acc["limit"].alias("limit"),
            ),
        )["kept"]
        kept = F.slice(weights, 1, F.greatest(count, F.lit(1)))
        return F.when(top_p < 1.0, kept).otherwise(weights)

    def normalise(weights: Column) -> Column:
        return bind(
            total(weights["weight"]),
            lambda all: F.transform(
                weights,
                lambda w: F.struct(w["token_id"].alias("token_id"), (w["weight"] / all).alias("prob")),
            ),
        )

    return bind(
        ordered, lambda s: bind(top(s), lambda k: bind(weigh(k), lambda w: bind(nucleus(w), normalise)))
    )


def uniform(seed: int, *keys: Column) -> Column:
    """A reproducible number in [0, 1) for the given keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


DRAW_BLOCK = 64


def block_sums(probs: Column, block: int = DRAW_BLOCK) -> Column:
    """Probability sums of runs of ``block`` tokens; they shorten repeated draws."""

    def sums(probs: Column) -> Column:
        last = F.floor((F.size(probs) - 1) / block).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda k: total(F.slice(probs, k * block + 1, block)["prob"]),
        )

    return bind(probs, sums)


def draw(probs: Column, u: Column, blocks: Column | None = None, block: int = DRAW_BLOCK) -> Column:
    """The first token whose cumulative probability exceeds ``u``.

    Only the block sums and one block are walked.  When rounding leaves the last
    sum below ``u``, the last token is drawn.
    """
    blocks = block_sums(probs, block) if blocks is None else blocks
    start = F.struct(
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("before"),
        F.lit(0).alias("passed"),
        u.alias("u"),
    )

    def find_block(acc: Column, x: Column) -> Column:
        upto = acc["sum"] + x
        beyond = upto <= acc["u"]
        return F.struct(
            upto.alias("sum"),
            F.when(beyond, upto).otherwise(acc["before"]).alias("before"),
            (acc["passed"] + beyond.cast("int")).alias("passed"),
            acc["u"].alias("u"),
        )

    def find_token(found: Column) -> Column:
        first = F.struct(
            found["before"].alias("sum"),
            F.lit(None).cast("int").alias("token_id"),
            found["u"].alias("u"),
        )
        run = F.slice(probs, found["passed"] * block + 1, block)
        token = F.aggregate(
            run,
            first,
            lambda acc, p: F.struct(
                (acc["sum"] + p["prob"]).alias("sum"),
                F.coalesce(
                    acc["token_id"], F.when(acc["sum"] + p["prob"] > acc["u"], p["token_id"])
                ).alias("token_id"),
                acc["u"].alias("u"),
            ),
        )["token_id"]
        rest = F.get(run, F.size(run) - 1)["token_id"]
        return F.coalesce(token, rest, F.get(probs, F.size(probs) - 1)["token_id"])

    return bind(F.aggregate(blocks, start, find_block), find_token)


def choose_rank(
    levels: Column, u: Column, temperature: Setting = 1.0, top_k: Setting = -1, top_p: Setting = 1.0
) -> Column:
    """The rank, from 1, that ``u`` draws from counted successors.

    ``levels`` are ``array<struct<first, n, m>>`` by falling ``n``: the ``m`` successors with
    the count ``n`` have the ranks from ``first`` on.  Their logits are log counts, so all of a
    level weigh the same whatever the settings, and filters and draw need the levels only:
    the top k with ties are whole levels, and the nucleus ends inside one of them.  Filters
    as in ``filter_candidates``, draw as in ``draw``; all in doubles, NULL without levels.
    """
    temperature, top_k, top_p = map(as_column, (temperature, top_k, top_p))
    scale = F.lit(1.0) / F.greatest(temperature, F.lit(1e-5))

    def weigh(levels: Column) -> Column:
        kept = F.when(top_k > 0, F.filter(levels, lambda l: l["first"] <= top_k)).otherwise(levels)
        top = F.get(levels, F.lit(0))["n"]
        return F.transform(
            kept,
            lambda l: F.struct(
                l["first"].cast("double").alias("first"),
                l["m"].cast("double").alias("m"),
                F.when(temperature == 1.0, l["n"].cast("double")).otherwise(F.pow(l["n"] / top, scale)).alias("w"),
            ),
        )

    def inside(acc: Column, l: Column) -> Column:
        """How many of a level the nucleus has: those with at most ``limit`` before them."""
        reached = F.least(l["m"], F.floor(F.least(l["m"], (acc["limit"] - acc["before"]) / l["w"])) + 1)
        some = F.when(l["w"] > 0, reached).otherwise(l["m"])
        return F.when(acc["before"] <= acc["limit"], some).otherwise(0.0).cast("double")

    def start(limit: Column, target: Column) -> Column:
        return F.struct(
            F.lit(0.0).alias("before"),
            limit.alias("limit"),
            F.lit(0.0).alias("kept"),
            target.alias("target"),
            F.lit(None).cast("double").alias("rank"),
            F.lit(None).cast("double").alias("last"),
        )

    def step(acc: Column, l: Column) -> Column:
        def go_on(count: Column) -> Column:
            upto = acc["kept"] + count * l["w"]
            beyond = F.when(l["w"] > 0, F.floor((acc["target"] - acc["kept"]) / l["w"])).otherwise(0.0)
            here = l["first"] + F.least(beyond.cast("double"), count - 1)
            return F.struct(
                (acc["before"] + l["m"] * l["w"]).alias("before"),
                acc["limit"].alias("limit"),
                upto.alias("kept"),
                acc["target"].alias("target"),
                F.coalesce(acc["rank"], F.when((count > 0) & (upto > acc["target"]), here)).alias("rank"),
                F.when(count > 0, l["first"] + count - 1).otherwise(acc["last"]).alias("last"),
            )

        return bind(F.when(top_p < 1.0, inside(acc, l)).otherwise(l["m"]), go_on)

    def pick(weighted: Column) -> Column:
        limit = F.aggregate(weighted, F.lit(0.0), lambda sum, l: sum + l["m"] * l["w"]) * top_p

        def drawn(limit: Column) -> Column:
            kept = F.aggregate(weighted, start(limit, F.lit(0.0)), step)["kept"]
            found = bind(u * kept, lambda target: F.aggregate(weighted, start(limit, target), step))
            # When rounding leaves the last sum below the target, the last one is drawn.
            return bind(found, lambda acc: F.coalesce(acc["rank"], acc["last"]))

        return bind(limit, drawn)

    return bind(weigh(levels), pick).cast("long")
