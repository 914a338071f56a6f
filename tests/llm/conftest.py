import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Words whose polynomials modulo a power of two are equal whatever their letters count.
THUE_MORSE = "".join("ab"[i.bit_count() & 1] for i in range(2048))
COMPLEMENT = THUE_MORSE.translate(str.maketrans("ab", "ba"))

#: Texts that every operator must stand: null, empty, blank, one word, long, odd bytes.
ODD_TEXTS = [
    None, "", " \n\t ", "x", "A", "a b c d", "x " * 300, "x " * 157 + "y " + "x " * 160,
    "a b " * 120, "a a b b " * 50, "é" * 300, "ab" * 240, "x" * 5000, "é 日本語 \u0000 👍🏽  👍",
    "line one here\nline two here\n\nline one here\nline two here",
    THUE_MORSE, COMPLEMENT, f"{THUE_MORSE}\n{COMPLEMENT}\n{THUE_MORSE}",
    *(" ".join([word, *map(str, range(30))]) for word in (THUE_MORSE, COMPLEMENT)),
    *(" ".join(word) for word in (THUE_MORSE, COMPLEMENT)),
]


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Odd texts with null and repeated ids, repeated rows and clashing extra columns."""
    rows = [(i, t, f"s{i % 3}", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += rows[4:9] + [(None, "null id " * 40, None, 3), (None, "null id " * 40, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for name in ("id", "mark", "key", "node", "n", "hash", "found", "kept", "n_words", "score", "ids", "doc", "label"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def small_documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


def words(text):
    return WORD.findall(text or "")


def order(doc_id):
    """Ids in order, null first."""
    return -(2**63) if doc_id is None else doc_id


def pairs(df):
    """``(doc_id, text)`` of all rows."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
