"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character 3- to 6-grams (with word borders) and itself, each
hashed to one of ``BUCKETS`` embedding rows; a passage is the average of its words'
bags, and a two-class linear softmax reads it.  Embeddings and softmax are trained
together in numpy, so a misspelling shares most of its vectors with the word it
imitates.  A text is as toxic as its worst passage of ``PASSAGE`` words: a rude word
weighs the same in a short and in a very long text.  Training follows: a toxic text
teaches through its currently worst passage, a clean one through its worst and one
other.

For scoring, softmax and embeddings collapse into one weight per bucket, so a task
holds one vector of ``BUCKETS`` floats and looks every n-gram of the text up in it.

Defined cases: a null text counts as empty; an empty text gets the score of the bias
alone; rows are scored one by one, so repeated rows agree; labels that are null or of
unknown documents are not used; without labels of both classes every score is 0 (or
the only class); an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import LOWER_CODE, SpanHash, Texts, distinct, find_words, mix, slices, spread_ranges, take_ranges
from millrace.llm.trees import sigmoid

BUCKETS = 2**18
DIMENSION = 4
GRAMS = (3, 4, 5, 6)
PASSAGE = 4

#: Labelled rows of each class that the model is fitted on, at most: those with the
#: smallest hash.
MAX_LABELLED = 3_000

#: Bytes of a text that the model is fitted on, at most.
MAX_BYTES = 2**16

#: An n-gram bucket gets a vector if its words are in this many training texts.
LEAST_TEXTS = 5

TOXIC_SHARE = 0.3  # of the weight of all training texts
AVERAGE_ROUNDS = 12  # on whole texts, before single passages can be told apart
AVERAGE_TEXTS = 800  # drawn for each of these rounds
PASSAGE_ROUNDS = 60
RATE = 0.3


@dataclass
class Bags:
    """N-gram buckets of words: ``bucket[first[w]:first[w + 1]]`` is word w's bag."""

    bucket: np.ndarray
    first: np.ndarray


def grams_of(texts: Texts, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words given as spans, and the word that each belongs to."""
    span = SpanHash(LOWER_CODE[texts.data])
    owners, grams = [np.arange(len(start), dtype=np.int32)], [span.of(start, end)]
    border = np.uint64(0xA5A5A5A5)
    for n in GRAMS:
        count = np.maximum(end - start - n + 1, 0)
        at, owner = spread_ranges(start, count)
        gram = span.of(at, at + n)
        opens = (np.cumsum(count) - count)[count > 0]
        owner = owner.astype(np.int32)
        owners += [owner, owner[opens]]
        grams += [gram, mix(gram[opens] ^ border)]
    bucket = np.concatenate(grams) & np.uint64(BUCKETS - 1)
    return bucket.astype(np.int32), np.concatenate(owners)


def word_bags(texts: Texts, start: np.ndarray, end: np.ndarray) -> Bags:
    bucket, owner = grams_of(texts, start, end)
    order = np.argsort(owner, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(start)))])
    return Bags(bucket[order], first)


@dataclass
class Model:
    """The trained model, folded: one weight per bucket and a bias."""

    weight: np.ndarray
    bias: float

    def word_values(self, texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """What each word adds to its passage's average."""
        bucket, owner = grams_of(texts, start, end)
        total = np.bincount(owner, self.weight[bucket], len(start))
        return total / np.maximum(np.bincount(owner, minlength=len(start)), 1)

    def score(self, texts: Texts) -> np.ndarray:
        """The probability of label 1 for each text of a slice."""
        words = find_words(texts)
        margin = np.full(len(texts), self.bias)
        if len(words):
            value = self.word_values(texts, words.start, words.end)
            worst, _ = worst_passages(value, words.first)
            filled = np.diff(words.first) > 0
            margin[filled] += worst
        return sigmoid(margin)


def worst_passages(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text with words: the largest passage average and that passage's first word.

    A text shorter than a passage is one passage of its own length.
    """
    count = np.diff(first)
    filled = np.flatnonzero(count)
    starts = first[:-1][filled]
    total = np.concatenate([[0.0], np.cumsum(value)])
    average = np.full(len(value), -np.inf)
    average[: max(0, len(value) - PASSAGE + 1)] = (total[PASSAGE:] - total[:-PASSAGE]) / PASSAGE
    last, _ = spread_ranges(np.maximum(first[1:] - PASSAGE + 1, first[:-1])[filled], np.minimum(PASSAGE - 1, count[filled]))
    average[last] = -np.inf
    short = filled[count[filled] < PASSAGE]
    average[first[short]] = (total[first[short + 1]] - total[first[short]]) / count[short]
    worst = np.maximum.reduceat(average, starts)
    hit = np.flatnonzero(average == np.repeat(worst, count[filled]))
    return worst, hit[np.searchsorted(hit, starts)]


@dataclass
class Sample:
    """Training texts: word ids, their borders, the distinct words' bags, labels."""

    word: np.ndarray
    first: np.ndarray
    bags: Bags
    label: np.ndarray


def sample_of(batch: pa.RecordBatch) -> Sample:
    """Words of a bounded sample; each distinct word's bag is built once."""
    bags, counts, words, borders, labels = [], [np.zeros(1, np.int64)], [], [0], []
    known, number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    for texts in slices(batch):
        found = find_words(texts)
        key = SpanHash(LOWER_CODE[texts.data]).of(found.start, found.end)
        where, back = distinct(key)
        keys = key[where]
        at = np.searchsorted(known, keys)
        old = known[np.minimum(at, len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)
        ids = np.empty(len(keys), np.int32)
        ids[old] = number[at[old]]
        ids[~old] = len(known) + np.arange((~old).sum())
        part = word_bags(texts, found.start[where[~old]], found.end[where[~old]])
        bags.append(part.bucket)
        counts.append(np.diff(part.first))
        known, number = np.concatenate([known, keys[~old]]), np.concatenate([number, ids[~old]])
        order = np.argsort(known)
        known, number = known[order], number[order]
        words.append(ids[back])
        borders.extend((found.first[1:] + borders[-1]).tolist())
        labels.append(texts.rows.column("label").to_numpy(zero_copy_only=False))
    first = np.cumsum(np.concatenate(counts))
    return Sample(np.concatenate(words), np.array(borders), Bags(np.concatenate(bags), first), np.concatenate(labels))


def well_known(sample: Sample) -> np.ndarray:
    """Buckets met in enough training texts; the others keep a vector of zeros."""
    owner = np.repeat(np.arange(len(sample.label)), np.diff(sample.first))
    words = len(sample.bags.first) - 1
    pairs = np.unique(owner * np.int64(words) + sample.word)
    del owner
    texts = np.bincount(pairs % words, minlength=words)
    spread = np.repeat(texts, np.diff(sample.bags.first))
    return np.bincount(sample.bags.bucket, spread, BUCKETS) >= LEAST_TEXTS


def fit(sample: Sample, seed: int = 7) -> Model:
    """Embeddings and softmax trained together by full-batch Adagrad."""
    filled = np.diff(sample.first) > 0
    label = sample.label[filled]
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(BUCKETS), 40.0 if len(label) and label[0] > 0.5 else -40.0)
    size = np.diff(sample.first)[filled]
    starts = sample.first[:-1][filled]
    first = np.concatenate([[0], np.cumsum(size)])
    random = np.random.default_rng(seed)
    bags = sample.bags
    bag_size = np.diff(bags.first)
    known = well_known(sample)
    table = (random.normal(0, 0.1, (DIMENSION, BUCKETS)) * known).astype(np.float32)
    softmax = random.normal(0, 0.5, (DIMENSION, 2))
    bias = np.zeros(2)
    pasts = [np.full_like(x, 1e-8) for x in (table, softmax, bias)]
    share = np.where(label > 0.5, TOXIC_SHARE / label.mean(), (1 - TOXIC_SHARE) / (1 - label.mean()))

    for round_ in range(AVERAGE_ROUNDS + PASSAGE_ROUNDS):
        # Which stretch of which text teaches in this round: text, first word, words.
        if round_ < AVERAGE_ROUNDS:
            text = np.sort(random.permutation(len(size))[:AVERAGE_TEXTS])
            at, count = starts[text], size[text]
        else:
            value = ((softmax[:, 1] - softmax[:, 0]).astype(np.float32) @ table)[bags.bucket]
            value = np.add.reduceat(value, bags.first[:-1]) / bag_size
            _, at = worst_passages(value[sample.word], first)
            clean = np.flatnonzero(label < 0.5)
            other = starts[clean] + random.integers(0, np.maximum(size[clean] - PASSAGE, 0) + 1)
            text = np.concatenate([np.arange(len(size)), clean])
            at = np.concatenate([at, other])
            count = np.minimum(PASSAGE, size[text])
        place, owner = spread_ranges(at, count)
        used, word = np.unique(sample.word[place], return_inverse=True)
        bucket, _ = take_ranges(bags.bucket, bags.first, used)
        entry_word = np.repeat(np.arange(len(used), dtype=np.int32), bag_size[used])
        borders = np.cumsum(bag_size[used]) - bag_size[used]
        passage_borders = np.cumsum(count) - count
        passage = np.empty((len(text), DIMENSION))
        for d in range(DIMENSION):
            vector = np.add.reduceat(table[d][bucket], borders) / bag_size[used]
            passage[:, d] = np.add.reduceat(vector[word], passage_borders) / count
        p = sigmoid((passage @ softmax + bias) @ np.array([-1.0, 1.0]))
        error = (label[text] - p) * share[text] / len(text)
        error = np.stack([-error, error], 1)
        slope = (error @ softmax.T) / count[:, None]
        for d in range(DIMENSION):
            pull = np.bincount(word, slope[owner, d], len(used)) / bag_size[used]
            step = np.bincount(bucket, pull[entry_word], BUCKETS) * known
            pasts[0][d] += step**2
            table[d] += RATE * step / np.sqrt(pasts[0][d])
        for parameter, step, past in ((softmax, passage.T @ error, pasts[1]), (bias, error.sum(axis=0), pasts[2])):
            past += step**2
            parameter += RATE * step / np.sqrt(past)
    return fold(table, softmax, bias)


def fold(table: np.ndarray, softmax: np.ndarray, bias: np.ndarray) -> Model:
    """The model whose softmax over averaged embeddings is one weighted average."""
    return Model(((softmax[:, 1] - softmax[:, 0]) @ table).astype(np.float32), float(bias[1] - bias[0]))


def crc_remainder(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(
    documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES
) -> Model:
    """A model from at most ``max_labelled`` rows of each label that are not held out.

    Documents of the sample with over ``max_bytes`` of text teach nothing, and one text of
    each id does, so what comes to the driver is bounded.
    """
    rows = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(crc_remainder("doc_id") != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("label"))
    )
    order = F.xxhash64("doc_id"), "doc_id"
    sample = reduce(
        DataFrame.unionByName,
        [rows.where(side).orderBy(*order).limit(max_labelled) for side in ("label > 0", "label <= 0")],
    )
    rows = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by([("doc_id", "ascending")])
        .combine_chunks()
    )
    if not rows.num_rows:
        return Model(np.zeros(BUCKETS), -40.0)
    return fit(sample_of(rows.to_batches()[0]))


def score_toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            for texts in slices(batch):
                points = here.score(texts)
                columns = [texts.rows.column("doc_id"), pa.array(points), pa.array((points >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    source = documents.select("doc_id", "text")
    schema = source.select("doc_id").schema.add("score", "double").add("predicted", "integer")
    return source.mapInArrow(score, schema)
