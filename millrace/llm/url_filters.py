"""URL filters with redirect equivalence.

A page is judged by the longest rule that fits its url.  Pages no rule fits are judged
through their aliases: redirects and canonical links make urls equivalent, distributed
connected components find the classes, and a class with a blocked url blocks all of
its urls, except those that a rule allows explicitly.

Urls are compared without scheme and fragment.  Edges come from the pages themselves
(``<link rel=canonical>``, ``<meta http-equiv=refresh>``) and from tables of redirects.

Defined cases: the same rule given as allow and block allows; a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed; null html has no links; an unresolvable link is ignored; repeated
rows get the same verdict; no rules or no pages are fine; extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.sources.scratch import cut_lineage

LINK = r"(?i)<link\b[^>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META = r"(?i)<meta\b[^>]*>"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def after_scheme(url: Column) -> Column:
    """The url after its first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def url_node(url: Column) -> Column:
    """What equivalent spellings share: host, path and query; null without a host."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    host = url_host(url)
    return F.when(host != "", F.concat(host, rest))


def resolve(link: Column, url: Column) -> Column:
    """The absolute url of a link on a page."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("x://"), url_host(url))
    folder = F.regexp_replace(url_path(url), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(F.instr(link, "://") > 0, link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("#"), F.lit(None))
        .otherwise(F.concat(base, folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between urls: each page's canonical link and refresh target."""
    tags = F.concat(
        F.transform(
            F.filter(F.regexp_extract_all("html", F.lit(LINK), F.lit(0)), lambda t: F.rlike(t, F.lit(CANONICAL))),
            lambda t: F.regexp_extract(t, HREF, 1),
        ),
        F.transform(
            F.filter(F.regexp_extract_all("html", F.lit(META), F.lit(0)), lambda t: F.rlike(t, F.lit(REFRESH))),
            lambda t: F.regexp_extract(t, REFRESH_URL, 1),
        ),
    )
    links = pages.select("url", F.explode(tags).alias("link")).where("link != ''")
    return links.select(
        url_node(F.col("url")).alias("a"), url_node(resolve(F.col("link"), F.col("url"))).alias("b")
    )


def rule_table(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule, verdict, rule_host, rule_path)`` of ``(verdict, "host/path")`` pairs."""
    rows = [(rule, verdict, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]
    return pages.sparkSession.createDataFrame(
        rows, "rule string, rule_verdict string, rule_host string, rule_path string"
    )


def longest_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``(host, path)`` of ``urls`` with the longest rule that fits, if any.

    Each host is looked up under all of its parent domains, so any number of rules is
    one hash join.
    """
    places = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    # A rule that is given as both allows.
    allows = (F.col("rule_verdict") == "allow").alias("allows")
    found = (
        places.withColumn("rule_host", F.explode(parents))
        .join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("size"), "rule", allows)).alias("best"))
    )
    verdict = F.when(F.col("best.allows"), "allow").otherwise("block")
    return found.select("host", "path", "best.rule", verdict.alias("rule_verdict"))


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``node`` of every url that is equivalent to a blocked one."""
    classes = cut_lineage(components(edges), "aliases")
    parts = classes.withColumns(
        {
            "host": F.regexp_extract("node", r"^[^/?#]*", 0),
            "path": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1),
        }
    )
    judged = parts.join(longest_rule(parts, rules), ["host", "path"])
    blocked = judged.where("rule_verdict = 'block'").select("component").distinct()
    return classes.join(blocked, "component", "left_semi").select("node")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias_blocked)`` of every page.

    ``rules`` are ``(allow | block, "host/path")`` pairs; ``redirects`` has url columns
    ``source`` and ``target``.
    """
    table = rule_table(pages, rules)
    edges = page_links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(
            redirects.select(url_node(F.col("source")).alias("a"), url_node(F.col("target")).alias("b"))
        )
    url = F.col("url")
    places = pages.select(
        "page_id", url_host(url).alias("host"), url_path(url).alias("path"), url_node(url).alias("node")
    )
    aliases = blocked_aliases(edges, table).withColumn("alias_blocked", F.lit(True))
    named = places.where("node IS NOT NULL")
    judged = named.join(longest_rule(named, table), ["host", "path"], "left").join(aliases, "node", "left")
    # Urls without a host fit nothing and would all meet in one task.
    nameless = places.where("node IS NULL")
    nothing = {c: F.lit(None).cast(dict(judged.dtypes)[c]) for c in ("rule", "rule_verdict", "alias_blocked")}
    return judged.unionByName(nameless.withColumns(nothing)).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"),
    )
