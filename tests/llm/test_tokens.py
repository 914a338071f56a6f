"""Packed ids and SentencePiece chunks against the libraries."""

import hashlib
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import packed_ids, pieces, queries

from .conftest import order, pairs

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    "", None, " ", "  ", " a", "a ", "a  b   c ", "\n\n x\r\n y\t z", "▁a▁▁b ▁", "x" * 3000, " " * 70 + "q",
    "é 日本語 \u0000 x 👍🏽  👍", "<s> </s> <unk> <0x41>", "  　 ", "á b", "\ufeff �",
    "Don't <|endoftext|>x <|startoftext|> IT'S 12ab, a<|endoftext|>b", "ΑΣ ΌΣ, ﬁ  x", " ́a á", "İstanbul ẞ 'S'T",
    "a,b!!c;d(e)f... e\u0301, \u0301, x\u0301'll ''s 'sand <b>X</b> a_b 1,2",
]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    more = spark.createDataFrame([(100 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return more.unionByName(odd_rows.select("doc_id", "text"))


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_any_range_of_packed_ids_is_read(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 10_000, dtype=np.uint64)
    image = packed_ids.shard_image(ids, np.array([7]), np.array([False]), np.array([10_000]), bits)
    shard = packed_ids.Shard.open(image)
    for start, stop in ((0, 10_000), (0, 1), (4095, 4097), (4096, 8192), (9_999, 20_000), (5, 5)):
        assert (shard.read(start, stop) == ids[start:stop]).all()
    assert (shard.document(0) == ids).all()
    assert len(image) < 10_000 * bits / 8 + 64 * 8 + 200


def expected_packed(rows):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer, at, out = Tokenizer.from_file(WORDS), 0, []
    for doc_id, text in sorted(rows, key=lambda r: order(r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((order(doc_id), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def packed(spark, df, folder):
    packed_ids.write_packed(df, str(folder), WORDS, end=1)
    rows = packed_ids.read_packed(spark, str(folder)).withColumn("crc", F.crc32("ids")).collect()
    return sorted((order(r.doc_id), r.start, r.n_tokens, r.crc) for r in rows)


def test_packed_ids_of_given_documents(spark, small_documents, tmp_path):
    assert packed(spark, small_documents, tmp_path / "a") == expected_packed(pairs(small_documents))


def test_packed_ids_of_odd_rows(spark, odd, tmp_path):
    found, expected = packed(spark, odd, tmp_path / "a"), expected_packed(pairs(odd))
    assert sorted((i, n, c) for i, _, n, c in found) == sorted((i, n, c) for i, _, n, c in expected)
    ends = sorted((start, start + n) for _, start, n, _ in found)
    assert [a for a, _ in ends] == [0] + [b for _, b in ends[:-1]]


def test_a_range_of_places_reads_its_shards_only(spark, odd, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    packed_ids.write_packed(odd.repartition(4), folder, WORDS, end=1)
    whole = b"".join(r.ids for r in packed_ids.read_packed(spark, folder).orderBy("start").collect())
    n = len(whole) // 4
    for start, stop in ((0, n), (0, 1), (n // 3, n // 2), (n - 1, n + 50), (5, 5), (n, n + 1)):
        rows = packed_ids.read_range(spark, folder, start, stop).orderBy("start").collect()
        assert b"".join(r.ids for r in rows) == whole[4 * start : 4 * stop]
        assert [r.start for r in rows] == sorted({max(start, r.start) for r in rows})


def test_no_documents_give_no_shards(spark, odd, tmp_path):
    assert packed(spark, odd.limit(0), tmp_path / "a") == []


def expected_pieces(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for doc_id, text in rows:
        ids = model.encode(text or "", add_bos=True, add_eos=True)
        yield (
            order(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(model.decode(ids).encode()).hexdigest(),
        )


@pytest.mark.parametrize("rows", [0, 50, pieces.TABLE_ROWS])
def test_pieces_equal_the_library(small_documents, odd, rows, monkeypatch):
    """With no table, a small one and a full one."""
    monkeypatch.setattr(pieces, "TABLE_ROWS", rows)
    df = small_documents.select("doc_id", "text").unionByName(odd)
    table = pieces.chunk_table(df, PIECES, rows)
    assert len(table.one) <= rows
    monkeypatch.setattr(pieces, "chunk_table", lambda *a: table)
    found = sorted((order(r[0]), *r[1:]) for r in queries.piece_digests(df).collect())
    assert found == sorted(expected_pieces(pairs(df)))


def test_decoding_ids_gives_the_texts_back(odd):
    encoded = pieces.encode_documents(odd, PIECES)
    both = encoded.join(pieces.decode_documents(encoded, PIECES).withColumnRenamed("decoded", "again"), "doc_id")
    assert both.where("decoded = again").select("doc_id").distinct().count() == encoded.where(
        "doc_id IS NOT NULL"
    ).select("doc_id").distinct().count()


def test_no_documents_no_pieces(odd):
    assert queries.piece_digests(odd.limit(0)).collect() == []
