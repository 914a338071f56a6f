"""Expressions over token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the training set-up.
IGNORE_INDEX = -100
PAD_ID = 50256
PAD_BUCKETS = (128, 256, 384, 512)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    The optimizer may copy a column's definition into a lambda, where it would
    be evaluated once per element; a lambda variable cannot be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def append_eos(tokens: Column, eos: Column | int) -> Column:
    """The tokens and the end token."""
    return F.concat(tokens, F.array(eos if isinstance(eos, Column) else F.lit(eos)))


def append_eos_truncate(tokens: Column, eos: Column | int, max_length: int) -> Column:
    """Append the end token, then cut, so that long rows lose it."""
    return F.slice(append_eos(tokens, eos), 1, max_length)


def ones_like(tokens: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(tokens))


def pad_to(tokens: Column, length: Column, value: int) -> Column:
    """Right-pad to ``length``; longer arrays stay as they are."""
    missing = F.greatest(length - F.size(tokens), F.lit(0)).cast("int")
    return F.concat(tokens, F.array_repeat(F.lit(value), missing))


def bucket_length(longest: Column) -> Column:
    """The smallest pad bucket that holds ``longest``; beyond the last, unchanged."""
    target = longest
    for size in reversed(PAD_BUCKETS):
        target = F.when(longest <= size, F.lit(size)).otherwise(target)
    return target


def masked_labels(tokens: Column, mask: Column, prompt_length: Column) -> Column:
    """Copy of ``tokens`` with the prompt and the masked places set to -100."""
    unmasked = F.zip_with(tokens, mask, lambda t, m: F.when(m == 0, IGNORE_INDEX).otherwise(t))
    return F.transform(
        unmasked, lambda t, i: F.when(i < prompt_length, IGNORE_INDEX).otherwise(t)
    )


def shifted_inputs(tokens: Column) -> Column:
    """All but the last token."""
    return F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def after_first(tokens: Column) -> Column:
    """All but the first token."""
    return F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))


def next_labels(tokens: Column, mask: Column) -> Column:
    """The token after each place, -100 where that place is masked."""
    return F.zip_with(
        after_first(tokens),
        after_first(mask),
        lambda t, m: F.when(m == 0, IGNORE_INDEX).otherwise(t),
    )


def ngrams(words: Column, n: int) -> Column:
    """Word n-grams joined by a blank (words hold none); empty below n words."""

    def cut(words: Column) -> Column:
        count = F.size(words) - (n - 1)
        grams = F.transform(
            F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))),
            lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]),
        )
        return F.when(count >= 1, grams).otherwise(F.array().cast("array<string>"))

    return bind(words, cut)


def ngram_diversity(words: Column, n: int = 3) -> Column:
    """Distinct share of the n-grams, 0.0 with fewer than n words."""
    return bind(
        ngrams(words, n),
        lambda grams: F.when(F.size(grams) == 0, 0.0).otherwise(
            F.size(F.array_distinct(grams)) / F.greatest(F.size(grams), F.lit(1))
        ),
    )
