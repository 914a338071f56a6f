"""Benchmark decontamination by templates: re-parameterised questions are caught too.

Numbers, the units after them and names are typed placeholders that keep their value
(``§n:42``); the other tokens are lower-cased words.  A window of ``WINDOW`` tokens
without the values is a template.  Templates of the benchmark are hash-joined with those
of the documents.  On each diagonal (document position less item position) the values
must be consistent: a value that the item repeats stands for one value in the document;
windows that hold one that does not are left out.  Capitalised words beside each other are
one name, and a word that only begins sentences may change freely.

Windows of the lower-cased tokens without placeholders are joined in the same way, so
items in another case, or with few words besides names and numbers, are found as well.

A document holds an item if, by templates or by words, matched windows cover at least
``MIN_COVERAGE`` of the item's tokens that windows with words enough cover, and
``MIN_TOKENS`` of them (or all of a shorter item), on diagonals where ``MIN_CONSISTENT`` of
the repeated names are steady, or if ``MIN_RUN`` tokens in a row match.  An item shorter
than a window is matched by its whole token sequence, from ``LEAST_TOKENS`` tokens on.

Only DataFrame functions run on the main path.  A window can only match where its two
longest literal words, its anchors, stand in the document at their distance: tokens are
first joined with the anchors of all item windows, and templates are built and hashed at
the windows around them alone.  Texts are parted once for both kinds of tokens and joined in
parts of ``PART`` tokens, so rows in flight do not grow with a text's length times its matches.
Item windows are counted; up to ``BROADCAST_ROWS`` they and their anchors are sent to the
documents, so that only matches are shuffled, and beyond that the templates of all windows
are shuffled and joined.

Defined cases: null and empty texts, and items of fewer than ``LEAST_TOKENS`` tokens, match
nothing; rows with one doc_id are told apart by their text, equal rows count once;
null ids are carried as null; repeated items are matched as one if their ids are equal;
an empty table on either side gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.once import compute_once
from millrace.sources.scratch import cut_lineage

WINDOW = 6
LEAST_LITERAL = 3  # tokens of a window that are no placeholders
LEAST_TOKENS = 3
MIN_COVERAGE = 0.5
MIN_TOKENS = 8
MIN_RUN = 13
MIN_CONSISTENT = 0.8
BROADCAST_ROWS = 2**18
PART = 1024  # tokens of a text that are looked at together

MARK = "§"
LOOSE = f"{MARK}p."  # of an item's token that only begins sentences
UNITS = (
    "km cm mm m kg mg g lb lbs oz ml l mph kmh kwh kw w v hz kilometer kilometers kilometre kilometres "
    "meter meters metre metres centimeter centimeters mile miles feet foot inch inches yard yards "
    "kilogram kilograms gram grams pound pounds ounce ounces ton tons liter liters litre litres "
    "gallon gallons cup cups second seconds minute minutes hour hours day days week weeks month months "
    "year years dollar dollars cent cents euro euros percent degree degrees"
).split()

#: A dot or comma inside a number does not part tokens: it becomes this letter first.  A
#: sign beside a number is a token of its own, this letter and the sign.
POINT = "\ua78f"
SIGNS = "$€£%"
#: Looks behind only where a sign or a capital stands: most characters are settled before.
SEPARATOR = rf"(?:[^\p{{L}}\p{{N}}\p{{M}}{SIGNS}]|[{SIGNS}](?<!{POINT}[{SIGNS}]))+"
NUMBER = rf"^[0-9][0-9{POINT}]*$"
NAME = r"\p{Lu}\p{Ll}"
JOINED = "\ua7f7"  # between the words of a name
START = "\ua78e"  # a token before the first of a sentence


def parted(text: Column) -> Column:
    """``text`` with signs and units parted from their numbers."""
    text = F.regexp_replace(text, r"([0-9])[.,](?=[0-9])", f"$1{POINT}")
    text = F.regexp_replace(text, r"([$€£]) ?(?=[0-9])", f" {POINT}$1 ")
    text = F.regexp_replace(text, r"([0-9]) ?([%€£])", f"$1 {POINT}$2 ")
    return F.regexp_replace(text, rf"([0-9])(?=(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}\p{{M}}]))", "$1 ")


def named(text: Column) -> Column:
    """``text`` with capitalised words beside each other joined into one name."""
    return F.regexp_replace(text, rf"(?={NAME})(?<![\p{{L}}\p{{N}}\p{{M}}])({NAME}[\p{{L}}\p{{M}}]*) (?={NAME})", f"$1{JOINED}")


def split_tokens(text: Column, plain: bool) -> Column:
    """The tokens of a parted text, ``plain`` ones in lower case."""
    return F.split(F.lower(text) if plain else named(text), SEPARATOR)


def raw_tokens(text: Column) -> Column:
    return split_tokens(parted(text), plain=False)


def plain_tokens(text: Column) -> Column:
    return split_tokens(parted(text), plain=True)


def only_starts(text: Column) -> Column:
    """Lower-cased capitalised tokens that only begin sentences: they need not be names."""
    marked = F.regexp_replace(named(parted(text)), rf"(^|[.!?:\n]\s*)(?={NAME})", f"$1 {START} ")
    tokens = F.filter(F.split(marked, SEPARATOR), lambda t: t != "")
    before = F.concat(F.array(F.lit("")), tokens)
    starts = F.filter(tokens, lambda t, i: F.get(before, i) == START)
    others = F.filter(tokens, lambda t, i: (F.get(before, i) != START) & t.rlike(f"^{NAME}"))
    return F.array_except(F.transform(starts, F.lower), F.transform(others, F.lower))


def valued(token: Column, before: Column) -> Column:
    """A token as a word or a placeholder with its value; ``before`` is the one before."""
    low = F.lower(token)
    return (
        F.when(token.rlike(NUMBER), F.concat(F.lit(f"{MARK}n:"), low))
        .when(token.startswith(POINT), F.concat(F.lit(f"{MARK}u:"), F.substring(token, 2, 1)))
        .when(token.rlike(f"^{NAME}"), F.concat(F.lit(f"{MARK}p:"), low))
        .when(low.isin(UNITS) & F.coalesce(before.rlike(NUMBER), F.lit(False)), F.concat(F.lit(f"{MARK}u:"), low))
        .otherwise(low)
    )


def valued_window(tokens: Column, start: Column, size: Column | int) -> Column:
    """``size`` tokens from place ``start`` (0-based) as ``valued`` ones."""
    return F.transform(
        F.sequence(start, start + size - 1),
        lambda i: valued(F.get(tokens, i), F.when(i > 0, F.get(tokens, i - 1))),
    )


def template_hash(window: Column) -> Column:
    """A hash of valued tokens without the values."""
    return F.xxhash64(
        F.transform(window, lambda t: F.when(t.startswith(MARK), F.substring(t, 1, 2)).otherwise(t))
    )


def item_windows(benchmark: DataFrame, window: int, plain: bool) -> DataFrame:
    """``(item_id, item_at, size, hash, item_tokens, anchors, n_tokens, n_covered, n_windows)``
    of the windows with words enough; anchors are the two longest words and their places in
    the window, ``n_covered`` counts the item's tokens in such windows.  ``plain`` ones are
    of words without placeholders, and of all tokens of an item shorter than ``window``."""
    text = F.col("text")
    tokens = F.filter((plain_tokens if plain else raw_tokens)(text), lambda t: t != "")
    rows = benchmark.where("text IS NOT NULL").distinct()
    rows = rows.select("item_id", tokens.alias("tokens"), only_starts(text).alias("starts"))
    rows = rows.where(F.size("tokens") >= (min(window, LEAST_TOKENS) if plain else window))
    rows = rows.withColumn("size", F.least(F.size("tokens"), F.lit(window)))
    places = F.sequence(F.lit(0), F.size("tokens") - F.col("size"))
    rows = rows.withColumn("n_tokens", F.size("tokens"))
    found = rows.select("item_id", "tokens", "starts", "size", "n_tokens", F.explode(places).alias("item_at"))
    valued_tokens = F.transform(
        valued_window(F.col("tokens"), F.col("item_at"), F.col("size")),
        lambda t: F.when(
            t.startswith(f"{MARK}p:") & F.array_contains("starts", F.substring(t, 4, 2**30)),
            F.concat(F.lit(LOOSE), F.substring(t, 4, 2**30)),
        ).otherwise(t),
    )
    item_tokens = F.slice("tokens", F.col("item_at") + 1, F.col("size")) if plain else valued_tokens
    found = found.select("item_id", "item_at", "size", "n_tokens", item_tokens.alias("item_tokens"))
    words = F.filter("item_tokens", lambda t: ~t.startswith(MARK))
    found = found.distinct().where(F.size(words) >= min(LEAST_LITERAL, LEAST_TOKENS))
    placed = F.transform("item_tokens", lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("offset"), t.alias("word")))
    longest = F.slice(F.array_sort(F.filter(placed, lambda x: ~x["word"].startswith(MARK))), 1, 2)
    found = found.withColumns({"hash": template_hash(F.col("item_tokens")), "anchors": longest})
    sizes = found.groupBy("item_id").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.size(F.array_distinct(F.flatten(F.collect_list(window_places())))).alias("n_covered"),
        F.countDistinct("item_at").alias("n_windows"),
    )
    null_safe = F.col("l.item_id").eqNullSafe(F.col("r.item_id"))
    joined = found.drop("n_tokens").alias("l").join(sizes.alias("r"), null_safe)
    return joined.select("l.*", "r.n_tokens", "r.n_covered", "r.n_windows")


def window_places() -> Column:
    """Places in the item of a window's tokens."""
    return F.sequence(F.col("item_at"), F.col("item_at") + F.col("size") - 1)


def token_parts(documents: DataFrame, window: int) -> DataFrame:
    """``(doc_id, mark, plain, start, part)``: the tokens of both kinds of every text, ``PART``
    of them from place ``start`` with ``window`` tokens on either side (blank before the first)."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("text IS NOT NULL")
    rows = compute_once(rows, {"text": parted(F.col("text"))})
    blank = F.array_repeat(F.lit(""), window)
    kinds = [
        F.struct(F.lit(plain).alias("plain"), F.concat(blank, split_tokens(F.col("text"), plain)).alias("tokens"))
        for plain in (False, True)
    ]
    rows = rows.select("doc_id", "mark", F.inline(F.array(*kinds)))
    starts = F.sequence(F.lit(0), F.size("tokens") - window - 1, F.lit(PART))
    part = lambda start: F.slice("tokens", start + 1, PART + 2 * window)
    parts = F.transform(starts, lambda start: F.struct(start.alias("start"), part(start).alias("part")))
    return rows.select("doc_id", "mark", "plain", F.inline(parts))


def matches(parts: DataFrame, items: DataFrame, window: int, broadcast: bool) -> DataFrame:
    """Windows of ``token_parts`` with the template of an item's window: the item's columns,
    ``at`` and the document's ``tokens``, valued unless ``plain``."""
    keys = items.drop("anchors")
    if broadcast:
        first, second = (F.get("anchors", F.lit(i)) for i in (0, 1))
        anchors = items.select(
            "plain", "size", first["word"].alias("anchor"), first["offset"].alias("offset"),
            second["word"].alias("other"), (second["offset"] - first["offset"]).alias("apart"),
        )
        placed = parts.select("doc_id", "mark", "plain", "start", "part", F.posexplode("part").alias("place", "token"))
        placed = placed.where(F.col("place").between(window, window + PART - 1))
        placed = placed.withColumn("anchor", F.lower("token")).join(F.broadcast(anchors.distinct()), ["plain", "anchor"])
        placed = placed.where(F.lower(F.get("part", F.col("place") + F.col("apart"))) == F.col("other"))
        placed = placed.withColumn("place", F.col("place") - F.col("offset"))
        placed = placed.where(F.col("place") <= F.size("part") - F.col("size"))
        keys = F.broadcast(keys)
    else:
        lengths = items.select("plain", "size").distinct()
        placed = parts.join(F.broadcast(lengths), "plain").where(F.size("part") >= F.col("size") + window)
        places = F.sequence(F.lit(window), F.least(F.lit(window + PART - 1), F.size("part") - F.col("size")))
        placed = placed.select("doc_id", "mark", "plain", "start", "part", "size", F.explode(places).alias("place"))
    at = F.col("start") + F.col("place") - window
    placed = placed.select("doc_id", "mark", "plain", "size", at.alias("at"), "part", "place").where(F.col("at") >= 0)
    # the rows of a part wait together: each holds its window and the token before it alone
    near = F.slice("part", F.col("place"), F.col("size") + 1)
    placed = compute_once(placed, {"near": near}).drop("part", "place")
    tokens = F.when(F.col("plain"), F.slice("near", 2, F.col("size")))
    tokens = tokens.otherwise(valued_window(F.col("near"), F.lit(1), F.col("size")))
    windows = placed.select("doc_id", "mark", "plain", "at", "size", tokens.alias("tokens"))
    return windows.withColumn("hash", template_hash(F.col("tokens"))).join(keys, ["plain", "size", "hash"])


def window_hits(documents: DataFrame, benchmark: DataFrame, window: int, broadcast_rows: int) -> DataFrame:
    """The windows of items in documents, with the diagonal; ``pairs`` of an item's
    placeholders and the document's."""
    kinds = [item_windows(benchmark, window, plain).withColumn("plain", F.lit(plain)) for plain in (False, True)]
    items = cut_lineage(kinds[0].unionByName(kinds[1]), "items")
    hits = matches(token_parts(documents, window), items, window, items.count() <= broadcast_rows).select(
        "doc_id",
        "mark",
        "item_id",
        "plain",
        "item_at",
        "size",
        "n_tokens",
        "n_covered",
        "n_windows",
        (F.col("at") - F.col("item_at")).alias("diagonal"),
        F.arrays_zip(F.col("item_tokens").alias("theirs"), F.col("tokens").alias("ours")).alias("pairs"),
    )
    same = F.forall(
        "pairs",
        lambda p: (p["theirs"] == p["ours"])
        | (p["theirs"].startswith(MARK) & (F.substring(p["theirs"], 1, 2) == F.substring(p["ours"], 1, 2))),
    )
    slots = F.transform("pairs", lambda p, i: F.struct((F.col("item_at") + i).alias("place"), p["theirs"].alias("theirs"), p["ours"].alias("ours")))
    slots = F.filter(slots, lambda p: p["theirs"].startswith(MARK))
    return hits.where(same).withColumn("pairs", slots)


def longest_run(ats: Column, size: Column) -> Column:
    """Tokens in a row that windows of ``size`` at the sorted places ``ats`` cover."""
    longest = F.aggregate(
        ats,
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, at: F.struct(
            at.alias("last"),
            F.when(at == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"),
            F.greatest(a["most"], F.when(at == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("most"),
        ),
        lambda a: a["most"],
    )
    return longest + size - 1


def find_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    min_coverage: float = MIN_COVERAGE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``(doc_id, mark, item_id, n_windows, n_matched, n_changed, coverage)``: the items
    that documents hold; ``mark`` is a hash of the text, ``n_changed`` counts the item's
    values that the document replaces, ``coverage`` is the share of tokens in matched windows."""
    benchmark = benchmark.select("item_id", "text")
    hits = cut_lineage(window_hits(documents, benchmark, window, broadcast_rows).distinct(), "hits")

    line = ["doc_id", "mark", "item_id", "diagonal"]
    slots = hits.where("NOT plain").select(*line, F.inline("pairs"))
    values = slots.groupBy(*line, "theirs").agg(
        F.min("ours").alias("low"),
        F.max("ours").alias("high"),
        (F.min("place") < F.max("place")).alias("repeated"),
    )
    steady = F.col("low") == F.col("high")
    unsteady = F.col("repeated") & ~steady & ~F.col("theirs").startswith(LOOSE)
    named = F.col("repeated") & F.col("theirs").startswith(f"{MARK}p:")
    slots = values.groupBy(*line).agg(
        F.collect_list(F.when(unsteady, F.col("theirs"))).alias("unsteady"),
        F.avg(F.when(named, steady.cast("double"))).alias("consistent"),
        F.sum((F.substring("low", 4, 2**30) != F.substring("theirs", 4, 2**30)).cast("long")).alias("changed"),
    )
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"s.{c}")) for c in line]
    holds = F.exists("pairs", lambda p: F.array_contains("unsteady", p["theirs"]))
    whole = F.coalesce(F.col("consistent"), F.lit(1.0)) >= MIN_CONSISTENT
    lines = (
        hits.alias("h")
        .join(slots.alias("s"), [~F.col("h.plain"), *on], "left")
        .where(~F.coalesce(holds, F.lit(False)))
        .groupBy("h.doc_id", "h.mark", "h.item_id", "h.plain", "h.diagonal")
        .agg(
            F.max("n_tokens").alias("n_tokens"),
            F.max("n_covered").alias("n_covered"),
            F.max("n_windows").alias("n_windows"),
            F.max("size").alias("size"),
            F.sort_array(F.collect_set("item_at")).alias("ats"),
            F.array_distinct(F.flatten(F.collect_list(window_places()))).alias("places"),
            F.max(F.coalesce("changed", F.lit(0))).alias("changed"),
            F.max(F.when(F.col("plain"), True).otherwise(whole)).alias("whole"),
        )
    )
    places = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    found = lines.groupBy("doc_id", "mark", "item_id", "plain").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.max("n_covered").alias("n_covered"),
        F.max("n_windows").alias("n_windows"),
        places("ats").cast("long").alias("n_matched"),
        F.max_by("changed", F.struct(F.size("places"), -F.col("changed"))).alias("n_changed"),
        places("places").alias("n_places"),
        places(F.when(F.col("whole"), F.col("places"))).alias("n_steady"),
        F.max(longest_run(F.col("ats"), F.col("size"))).alias("run"),
    )
    enough = (F.col("n_steady") >= min_coverage * F.col("n_covered")) & (
        F.col("n_steady") >= F.least("n_tokens", F.lit(MIN_TOKENS))
    )
    found = found.where(enough | (F.col("run") >= MIN_RUN))
    found = found.withColumn("coverage", F.col("n_places") / F.col("n_covered"))
    best = F.struct("coverage", ~F.col("plain"))
    columns = ["n_windows", "n_matched", "n_changed", "coverage"]
    found = found.groupBy("doc_id", "mark", "item_id").agg(F.max_by(F.struct(*columns), best).alias("best"))
    return found.select("doc_id", "mark", "item_id", "best.*")


def drop_leaking(documents: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``documents`` without those that hold an item of the benchmark."""
    leaks = find_leaks(documents, benchmark, **settings).select("doc_id", "mark").distinct()
    leaks = cut_lineage(leaks, "leaks")
    rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("doc.text") == F.col("mark"))
    return rows.join(leaks.hint("shuffle_hash"), same, "left_anti").select("doc.*")
