"""Text cleaning as native Column expressions.

Spark's ``trim`` knows only U+0020 and Java's ``\\s`` and ``\\w`` are ASCII, so
white space and words are spelled out here.  The white-space set and the accent
table are derived from the Unicode database instead of being listed.
"""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts the cleaning rules look for.
ADVERTISEMENT = "ADVERTISEMENT"
DROPPED_PHRASES = ("Watch how to make this recipe.",)
HTML_ELEMENT = r"<[^>]+>[^\n]*?</[^>]+>"
ALLOWED_CHARACTERS = string.ascii_letters + string.digits + " .,/:;'\"[]{}+=-_–()*&^%$#@!~\\|°<>?"
WORD = r"[\p{L}\p{N}_]+"

WHITESPACE = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
WHITESPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"


def bind(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body(col)``, with ``col`` evaluated once however often the body names it."""
    return F.transform(F.array(col), lambda x: body(x))[0]


def py_strip(col: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


@cache
def accent_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters whose unaccented form differs: a translation and the longer rest.

    The translation's left side ends with the combining marks, which have no
    partner on the right and are deleted.
    """
    plain, bare, longer, marks = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Mn":
            marks.append(char)
        if category in ("Mn", "Cs"):
            continue
        parts = unicodedata.normalize("NFD", char)
        if parts == char:
            continue
        kept = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        kept = unicodedata.normalize("NFC", kept)
        if kept == char:
            continue
        if len(kept) == 1:
            plain.append(char)
            bare.append(kept)
        else:
            longer.append((char, kept))
    return "".join(plain + marks), "".join(bare), tuple(longer)


@cache
def composites() -> tuple[tuple[str, str], ...]:
    """Pairs of characters that are no combining marks but compose, with the result."""
    found = []
    for code in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts)
            plain = all(unicodedata.category(c) != "Mn" for c in pair)
            if plain and unicodedata.normalize("NFC", pair) == chr(code):
                found.append((pair, chr(code)))
    return tuple(found)


# Hangul syllables are numbered by their letters: 21 vowels, 28 ends (the first: none).
LEADS, VOWELS, ENDS, SYLLABLES = (r"\x{1100}-\x{1112}", r"\x{1161}-\x{1175}", r"\x{11A8}-\x{11C2}", r"\x{AC00}-\x{D7A3}")


def compose_hangul(col: Column) -> Column:
    """Join letters of Hangul that follow each other into syllables."""
    letters = f"[{LEADS}][{VOWELS}][{ENDS}]?|[{SYLLABLES}][{ENDS}]|(?s).[^{LEADS}{SYLLABLES}]*"

    def code(part: Column, at: int) -> Column:
        return F.ascii(F.substring(part, at, 1))

    def syllable(code: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")

    def join(part: Column) -> Column:
        end = F.when(F.length(part) == 3, code(part, 3) - 0x11A7).otherwise(0)
        whole = 0xAC00 + ((code(part, 1) - 0x1100) * 21 + code(part, 2) - 0x1161) * 28 + end
        open_ = (code(part, 1) - 0xAC00) % 28 == 0
        longer = F.when(open_, syllable(code(part, 1) + code(part, 2) - 0x11A7)).otherwise(part)
        return (
            F.when(part.rlike(f"^[{LEADS}][{VOWELS}]"), syllable(whole))
            .when(part.rlike(f"^[{SYLLABLES}][{ENDS}]"), longer)
            .otherwise(part)
        )

    return F.array_join(F.transform(F.regexp_extract_all(col, F.lit(letters), F.lit(0)), join), "")


def compose(col: Column) -> Column:
    """Join characters that became neighbours when marks between them were deleted."""
    joined = col
    for pair, whole in composites():
        joined = F.replace(joined, F.lit(pair), F.lit(whole))
    seconds = "[" + "".join(f"\\x{{{ord(pair[1]):x}}}" for pair, _ in composites()) + "]"
    hangul = F.when(col.rlike(f"[{VOWELS}{ENDS}]"), compose_hangul(col)).otherwise(col)
    return F.when(~col.rlike(seconds), hangul).when(col.rlike(f"[{VOWELS}{ENDS}]"), compose_hangul(joined)).otherwise(joined)


def remove_accents(col: Column) -> Column:
    """Drop combining marks, replace accented characters by their base and compose.

    ASCII text, the common case, skips the tables altogether.  What a text needs is read
    off its other characters alone, which are few; the whole text is translated at most once.
    """
    plain, bare, longer = accent_table()
    rare = "[" + "".join(f"\\x{{{ord(c):x}}}" for c, _ in longer) + "]"
    late = "".join(f"\\x{{{ord(pair[1]):x}}}" for pair, _ in composites())

    def several(text: Column) -> Column:
        for char, kept in longer:
            text = F.replace(text, F.lit(char), F.lit(kept))
        return text

    def strip(text: Column, foreign: Column) -> Column:
        text = F.when(foreign.rlike(rare), several(text)).otherwise(text)
        stripped = F.when(F.translate(foreign, plain, bare) == foreign, text).otherwise(F.translate(text, plain, bare))
        joined = bind(stripped, compose)
        return F.when(foreign.rlike(f"[{VOWELS}{ENDS}{late}]"), joined).otherwise(stripped)

    def remove(text: Column) -> Column:
        foreign = F.regexp_replace(text, r"[\x00-\x7F]+", "")
        return bind(foreign, lambda x: F.when(x == "", text).otherwise(strip(text, x)))

    return bind(col, remove)


def remove_advertisement(col: Column) -> Column:
    return py_strip(F.replace(col, F.lit(ADVERTISEMENT), F.lit("")))


def replace_whitespace(col: Column) -> Column:
    """Delete line feeds and tabs, squeeze other white space to one blank, trim.

    One table lookup per character turns the rest into blanks and drops the two.  A text
    whose only white space are single blanks, as its other characters tell, is trimmed only.
    """
    others = "".join(c for c in WHITESPACE if c not in "\n\t")

    def blanks(text: Column) -> Column:
        rare = F.regexp_replace(text, "[ -~]+", "")
        spaced = F.translate(text, others + "\n\t", " " * len(others))
        return F.when(rare.rlike(WHITESPACE_CLASS), spaced).otherwise(text)

    def squeeze(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)

    return F.trim(bind(bind(col, blanks), squeeze))


def replace_phrases(col: Column, phrases: tuple[str, ...] = DROPPED_PHRASES) -> Column:
    for phrase in phrases:
        col = F.replace(col, F.lit(phrase), F.lit(""))
    return col


def remove_html_tags(col: Column) -> Column:
    """Delete ``<a>…</b>`` with its content, shortest match, within one line."""
    return bind(col, lambda x: F.when(F.contains(x, F.lit("</")), F.regexp_replace(x, HTML_ELEMENT, "")).otherwise(x))


def remove_special_characters(col: Column) -> Column:
    """Keep the allowed characters only: the runs of them, joined.

    The class names them one by one: a regular expression looks single characters up in a
    table, but compares with range after range.
    """
    allowed = "".join(f"\\x{{{ord(c):x}}}" for c in ALLOWED_CHARACTERS)
    return F.array_join(F.regexp_extract_all(col, F.lit(f"[{allowed}]+"), F.lit(0)), "")


def clean_text(col: Column) -> Column:
    """The cleaning order of titles and instructions."""
    for step in (
        remove_accents,
        remove_special_characters,
        replace_phrases,
        remove_html_tags,
        replace_whitespace,
    ):
        col = step(col)
    return col


def clean_ingredient(col: Column) -> Column:
    """The cleaning order of one ingredient, after the advertisement step."""
    for step in (
        remove_accents,
        replace_phrases,
        remove_html_tags,
        remove_special_characters,
        replace_whitespace,
    ):
        col = step(col)
    return col


def clean_ingredients(col: Column) -> Column:
    """Clean a list; only entries emptied by the advertisement step are dropped."""
    kept = F.filter(F.transform(col, remove_advertisement), lambda x: x != "")
    return F.transform(kept, clean_ingredient)


def word_tokens(col: Column) -> Column:
    """Lower-cased words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def recipe_to_string(
    title: Column,
    ingredients: Column,
    instructions: Column,
    source: Column | None = None,
    id: Column | None = None,
) -> Column:
    """Render a recipe; ``source`` and ``id`` add their own leading paragraphs."""
    items = F.array_join(F.transform(ingredients, lambda x: F.concat(F.lit("- "), x)), "\n")
    text = F.concat(
        F.lit("Title: "), title,
        F.lit("\n\nIngredients:\n"), items,
        F.lit("\n\nInstructions: "), instructions,
    )
    if source is not None:
        text = F.concat(F.lit("Source: "), source, F.lit("\n\n"), text)
    if id is not None:
        text = F.concat(F.lit("Id: "), id.cast("string"), F.lit("\n\n"), text)
    return text


# Line ends at which a captured ingredient block is cut into items.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def recipe_from_string(col: Column) -> Column:
    """Parse rendered text back to ``struct<title, ingredients, instructions>``."""
    ws = WHITESPACE_CLASS
    title = F.regexp_extract(col, rf"(?d)Title:{ws}*(.+)", 1)
    block = F.regexp_extract(col, rf"(?d)Ingredients:{ws}*((?:- .+\n?)+)", 1)
    steps = F.regexp_extract(col, rf"(?s)Instructions:{ws}*(.+)", 1)
    lines = F.transform(
        F.split(py_strip(block), LINE_END), lambda x: py_strip(F.substring(x, 3, 2147483647))
    )
    return F.struct(
        py_strip(title).alias("title"),
        F.when(block == "", F.array().cast("array<string>")).otherwise(lines).alias("ingredients"),
        py_strip(steps).alias("instructions"),
    )
