"""Quality rules: document statistics, base rules and boosted trees over them.

Statistics are computed in numpy over the bytes of whole texts, one pass per slice of
a batch and no shuffle.  The trees are fitted on the driver from a bounded sample of
labelled rows (``max_labelled``) and sent to the tasks as flat node arrays.

Defined cases: a null text counts as empty (all statistics 0, base rule failed); a row
is judged by itself, so repeated rows get the same verdict; labels that are null, of
unknown documents or repeated do not matter beyond their average; without labels the
trees keep everything that passes the base rules; an empty table gives no rows; extra
columns of ``documents`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from millrace.llm import trees
from millrace.llm.spans import SPACE, SpanHash, Texts, BYTE_CODE, find_words, hash_words, mix, slices, window_hashes

#: Labelled rows that the trees are fitted on, at most: those with the smallest hash.
MAX_LABELLED = 20_000

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Features of the trees and how the score may move with each: 1 only up, -1 only
#: down, 0 either way.  Junk marks can never help a document.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "capital_share": -1,
    "digit_share": 0,
    "mark_share": -1,
    "sentence_share": 0,
    "words_per_line": 0,
    "distinct_share": 0,
    "odd_share": -1,
}


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


SYMBOL = byte_class(b"#*$%&|<>")
CAPITAL = byte_class(bytes(range(65, 91)))
SMALL = byte_class(bytes(range(97, 123)))
DIGIT = byte_class(b"0123456789")
MARK = byte_class(b"!?")
STOP = byte_class(b".,;:")
CONTINUES = (np.arange(256) & 0xC0) == 0x80
ODD = byte_class(bytes([*range(0x20), 0x7F]) + b"{}[]\\^~_=+@`") & ~SPACE


def marked_again(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(texts: Texts) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of the texts of a slice."""
    n = len(texts)
    data = texts.data

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[texts.start])

    words = find_words(texts)
    owner = words.text_of()
    n_words = np.diff(words.first)
    hashes = hash_words(texts, words)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    inside = ~SPACE[data]
    symbols = per_text(SYMBOL[data])

    at, windows = window_hashes(hashes, words, WINDOW)
    again = at[marked_again(windows ^ salt[owner[at]])]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    n_repeat = np.bincount(owner, np.cumsum(cover)[:-1] > 0, n).astype(np.int64)

    order = np.unique(hashes ^ salt[owner], return_index=True)[1]
    n_distinct = np.bincount(owner[order], minlength=n)

    # Lines: cut after each newline and at each text's border.
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([texts.start[:-1], breaks + 1]))
    line_text = np.repeat(np.arange(n), per_text(data == 10) + 1)
    line_end = np.append(line_start[1:], len(data))
    closed = np.append(line_text[1:] == line_text[:-1], False)
    line_end = np.where(closed, line_end - 1, texts.start[line_text + 1])
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    filled = total[line_end] > total[line_start]
    line_hash = SpanHash(BYTE_CODE[data]).of(line_start, line_end)[filled]
    line_text = line_text[filled]
    n_lines = np.bincount(line_text, minlength=n)
    first = np.unique(line_hash ^ salt[line_text], return_index=True)[1]
    n_dup_lines = n_lines - np.bincount(line_text[first], minlength=n)

    word_chars = per_text(inside & ~CONTINUES[data])
    base = dict(zip(BASE, (n_words, word_chars, symbols, n_dup_lines, n_repeat)))
    some_words, some_lines = np.maximum(n_words, 1), np.maximum(n_lines, 1)
    letters = np.maximum(per_text(CAPITAL[data] | SMALL[data]), 1)
    features = np.stack(
        [
            np.log1p(n_words),
            word_chars / some_words,
            symbols / some_words,
            n_dup_lines / some_lines,
            n_repeat / some_words,
            per_text(CAPITAL[data]) / letters,
            per_text(DIGIT[data]) / np.maximum(word_chars, 1),
            per_text(MARK[data]) / some_words,
            per_text(STOP[data]) / some_words,
            n_words / some_lines,
            n_distinct / some_words,
            per_text(ODD[data]) / some_words,
        ],
        axis=1,
    )
    return base, features.astype(np.float64)


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    few = base["n_words"] < LEAST_WORDS
    return few | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])


def labelled_features(documents: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_labelled`` labelled documents, one text of each."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    chosen = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                _, x = statistics(texts)
                own = [texts.rows.column(c) for c in ("doc_id", "label")]
                yield pa.record_batch([*own, pa.array(list(x), pa.list_(pa.float64()))], schema.names)

    schema = chosen.select("doc_id", "label").schema.add("x", ArrayType(DoubleType()))
    found = chosen.mapInArrow(measure, schema)
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("label").alias("label")).toPandas()
    if not len(rows):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    rows["key"] = rows["x"].map(tuple)
    rows = rows.sort_values("key")  # the fit does not depend on the order of arrival
    return np.array(rows["x"].tolist()), (rows["label"].to_numpy() >= 0.5).astype(float)


def fit_rules(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> trees.Forest:
    """Trees that tell ``quality`` 1 from 0, from a bounded sample of labelled rows."""
    x, y = labelled_features(documents, labels, max_labelled)
    return trees.fit(x, y, np.array(list(FEATURES.values())))


def judge(documents: DataFrame, forest: trees.Forest, keep_at: float = 0.5) -> DataFrame:
    """``(doc_id, base counts, base_failed, score, kept)`` of every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                base, failed, points = verdicts(texts, shared.value)
                columns = [texts.rows.column("doc_id")]
                columns += [pa.array(v, pa.int64()) for v in base.values()]
                columns += [pa.array(failed), pa.array(points), pa.array(~failed & (points >= keep_at))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    source = documents.select("doc_id", "text")
    schema = source.select("doc_id").schema
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")
    return source.mapInArrow(score, schema)


def keep_good(documents: DataFrame, forest: trees.Forest, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that pass, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch):
                _, failed, points = verdicts(texts, shared.value)
                yield texts.rows.filter(pa.array(~failed & (points >= keep_at)))

    return documents.mapInArrow(keep, documents.schema)


def verdicts(texts: Texts, forest: trees.Forest) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    base, x = statistics(texts)
    return base, base_failed(base), forest.score(x)
