import random
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T

CLEANING = [
    ("Crème Brûlée", "Creme Brulee", ["Creme Brulee"]),
    ("Beef\nStew\t 1", "BeefStew 1", ["BeefStew 1"]),
    ("<b>Hot</b> Pie <br> now", "Pie <br> now", ["Pie <br> now"]),
    ("<i><b>n</b></i>", "</i>", ["</i>"]),
    ("Watch how to make this recipe. Mix", "Mix", ["Mix"]),
    ("a <p>x\ny</p> b", "a b", ["a <p>xy</p> b"]),
    ("½", "", [""]),
    ("a\xa0b", "ab", ["ab"]),
]


def values(spark, rows, expression):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def bare(texts):
    """Accents removed by another engine."""
    rows = duckdb.execute("SELECT list_transform(?, lambda x: strip_accents(x))", [texts]).fetchone()
    return rows[0]


def random_texts(count=400):
    rng = random.Random(7)
    alphabet = (
        "abzAZ019_ \n\t\r\x0b\x0c\x1c\x85\xa0  　éÉüßœÆçñ½²٣४漢字한́̈–°<>/p[]`'\"\\^$~|"
        "\U0001d15eೋİΣςﬁÅ"
    )
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(count)]


def test_cleaning_orders(spark):
    texts = [t for t, _, _ in CLEANING]
    assert values(spark, texts, T.clean_text(F.col("t"))) == [c for _, c, _ in CLEANING]
    listed = values(spark, texts, T.clean_ingredients(F.array("t")))
    assert listed == [i for _, _, i in CLEANING]


def test_ingredient_emptied_late_is_kept(spark):
    rows = [["ADVERTISEMENT", " 1 cup flour ADVERTISEMENT", "  ", "½"]]
    df = spark.createDataFrame([(r,) for r in rows], "x array<string>")
    assert df.select(T.clean_ingredients(F.col("x"))).first()[0] == ["1 cup flour", ""]


@pytest.mark.parametrize(
    "expression, given, expected",
    [
        (T.py_strip, ["  a b \t", "\x0b\x1c\x85\xa0x\u3000", "\u2028y\u200b", ""], ["a b", "x", "y\u200b", ""]),
        (T.remove_advertisement, ["ADVERTISEMENT", " 1 cup ADVERTISEMENT x ", "Advertisement"], ["", "1 cup  x", "Advertisement"]),
        (T.replace_whitespace, ["a\nb\tc  d", " a \r\n b ", "a\xa0\u2003b", "\n\t"], ["abc d", "a b", "a b", ""]),
        (
            T.remove_html_tags,
            ["<b>x</b>y", "<a><b>c</b>d</a>", "<br>no end", "a<p>x\ny</p>b", "<i></i><u>1</u>2", "< >z</ >"],
            ["y", "d</a>", "<br>no end", "a<p>x\ny</p>b", "2", ""],
        ),
        (
            T.remove_special_characters,
            ["azAZ09 .,/:;'\"[]{}+=-_\u2013()*&^%$#@!~\\|\u00b0<>?", "a\nb\tc`d", "\u00e9\u00bdx\u20ac\u2014", "\u0660"],
            ["azAZ09 .,/:;'\"[]{}+=-_\u2013()*&^%$#@!~\\|\u00b0<>?", "abcd", "x", ""],
        ),
        (T.word_tokens, ["The cat_1 sat; on-THE mat!", "\u00c9t\u00e9 \u6f22\u5b57 \u0663", "--", ""], [["the", "cat_1", "sat", "on", "the", "mat"], ["\u00e9t\u00e9", "\u6f22\u5b57", "\u0663"], [], []]),
    ],
)
def test_literal_rows(spark, expression, given, expected):
    assert values(spark, given, expression(F.col("t"))) == expected


def test_accents_equal_another_engine(spark):
    rng = random.Random(8)
    alphabet = "abzAZ019_ \n\t\xa0\u3000éÉüßœÆçñ½²漢字–°<>/iΣςﬁ\u0301\u0327\u0112"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(300)]
    assert values(spark, texts, T.remove_accents(F.col("t"))) == bare(texts)


def bare_by_normal_forms(text):
    parts = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))


def test_accents_of_all_characters_and_of_sequences_of_marks(spark):
    """Also letters of Hangul and spacing marks that become neighbours and compose."""
    codes = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) != "Cs"]
    texts = ["".join(codes[i : i + 50]) if i % 3 else " ".join(codes[i : i + 50]) for i in range(0, len(codes), 50)]
    rng = random.Random(5)
    pairs = [c for pair, _ in T.composites() for c in pair]
    hangul = [chr(c) for c in (0x1100, 0x1112, 0x1161, 0x1175, 0x11A8, 0x11C2, 0x11A7, 0x1113, 0xAC00, 0xAC01, 0xD788, 0xD7A3)]
    marks = [chr(c) for c in (0x300, 0x301, 0x327, 0x94D, 0xCC6, 0x1B35, 0x1B3C, 0x20D0)]
    letters = ["a", "é", "q", "ǖ", "한", "が", "\u212b", "\u0ccb", "\u09cb"]
    texts += ["".join(rng.choices(rng.choice([pairs + marks, hangul + marks, pairs + hangul + marks + letters]), k=9)) for _ in range(4000)]
    # Composing needs the order of marks that are neither deleted nor plain.
    odd = [c for c in codes if unicodedata.combining(c) and unicodedata.category(c) != "Mn"]
    texts = ["".join(c for c in t if c not in odd) for t in texts] + odd
    assert values(spark, texts, T.remove_accents(F.col("t"))) == [bare_by_normal_forms(t) for t in texts]


def test_accents_of_latin_greek_and_cyrillic_letters(spark):
    ranges = (range(0xC0, 0x250), range(0x386, 0x3CF), range(0x400, 0x460), range(0x1E00, 0x1F00))
    letters = [chr(code) for codes in ranges for code in codes]
    assert values(spark, letters, T.remove_accents(F.col("t"))) == bare(letters)


PARSING = [
    ("Title: A B\n\nIngredients:\n- x 1\n- y\n\nInstructions: do it\nthen",
     ("A B", ["x 1", "y"], "do it\nthen")),
    ("Title: \n\nIngredients:\n- x\n\nInstructions: z", ("Ingredients:", ["x"], "z")),
    ("Title: Q\n\nIngredients:\n\n\nInstructions: z", ("Q", [], "z")),
    ("no", ("", [], "")),
    ("Title: Q\n\nIngredients:\n- \n- y\n\nInstructions: ", ("Q", [], "")),
]


def test_parsing_quirks(spark):
    parsed = values(spark, [t for t, _ in PARSING], T.recipe_from_string(F.col("t")))
    assert [(p.title, p.ingredients, p.instructions) for p in parsed] == [e for _, e in PARSING]


def test_parsing_reverses_rendering(spark):
    rows = [("Pie", ["a b", "c"], "bake\nslowly"), ("Q (1)", ["x: y"], "Mix. Serve.")]
    df = spark.createDataFrame(rows, "title string, ingredients array<string>, instructions string")
    text = T.recipe_to_string(F.col("title"), F.col("ingredients"), F.col("instructions"))
    back = df.select(text.alias("t")).select(T.recipe_from_string(F.col("t")).alias("r")).select("r.*")
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_rendering_with_source_and_id(spark):
    df = spark.createDataFrame(
        [(7, "fn", "T", ["x"], "do")],
        "id long, source string, title string, ingredients array<string>, instructions string",
    )
    text = T.recipe_to_string(
        F.col("title"), F.col("ingredients"), F.col("instructions"), F.col("source"), F.col("id")
    )
    assert df.select(text).first()[0] == (
        "Id: 7\n\nSource: fn\n\nTitle: T\n\nIngredients:\n- x\n\nInstructions: do"
    )


STEPS = ["remove_accents", "remove_special_characters", "remove_html_tags", "replace_whitespace", "clean_text", "clean_ingredient"]


@pytest.mark.parametrize("step", STEPS)
def test_a_step_evaluates_its_argument_once(spark, step):
    """Named twice, the steps before it run twice."""
    assert str(getattr(T, step)(F.col("the_argument"))).count("the_argument") == 1


def test_cleaning_shortcuts_keep_every_case(spark):
    rows = [
        ("plain", "plain"), ("a  b", "a b"), ("a\u00a0b\u2003\u2003c", "a b c"), ("\u3000 x\u0085", "x"), ("a \n b", "a b"),
        ("a\tb", "ab"), ("é\u0301`e", "ee"), ("日本–ok😀", "–ok"), ("<b>x</b>y", "y"), ("</b>y", "</b>y"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, value string, wanted string")
    steps = [T.remove_accents, T.remove_special_characters, T.remove_html_tags]
    col = T.replace_whitespace(F.col("value"))
    for step in steps:
        col = step(col)
    got = df.select("i", col.alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [wanted for _, wanted in rows]
