"""URL rules with redirect equivalence.

A rule decides the urls of its host (and subdomains) below its path. Pages that redirect to one another, or name one
another as canonical, are aliases: a block by rule holds for all of them, unless one of them is explicitly allowed.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.common import cut_lineage
from lectern.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules become one column expression, so their number is a bounded parameter.
MOST_RULES = 1000


class Rule(NamedTuple):
    verdict: str  # allow or block
    text: str     # host, then a path that begins with a slash


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits (ties: the first by code point), else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        name, slash, rest = rule.text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(rule == r.text, F.lit(r.verdict)).otherwise(verdict)
    return verdict


def _without_dots(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments, as urls are resolved; most have none and stay as they are."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, part: F.when(part == ".", done).when(
        part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))))
    folder = F.when(path.rlike(r"/\.{1,2}\z") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def _key(url: Column) -> Column:
    """What two spellings of one url share: host, path and query; the scheme and the fragment are left out."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.concat(host_of(url), _without_dots(path_of(url)), query)


_CANONICAL = (
    r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s>/]))[^>]*>")
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_SCHEME = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"


def _resolved(href: Column, url: Column) -> Column:
    """``href`` against the url of its page: null for a scheme without a host (mailto:) and for a place in the page itself."""
    host, path = host_of(url), path_of(url)
    folder = F.concat(F.lit("http://"), host, F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^.*/", 0), F.lit("")), F.lit("/")))
    return (F.when(href.rlike(_SCHEME + "//"), href)
            .when(href.rlike(_SCHEME) | href.startswith("#"), F.lit(None))
            .when(href.startswith("//"), F.concat(F.lit("http:"), href))
            .when(href.startswith("/"), F.concat(F.lit("http://"), host, href))
            .when(host == "", F.lit(None))
            .when(href.startswith("?"), F.concat(F.lit("http://"), host, path, href))
            .otherwise(F.concat(folder, href)))


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b, target): keys of a page's url and of the url it redirects to or calls canonical, and that url itself.

    Read from ``<link rel=canonical href=...>``, where canonical is one of the words of rel, and ``<meta
    http-equiv=refresh content="n; url=...">``. A target is resolved against the page's url, whatever its form is;
    ``<base>`` is not read. A page whose url has no host can't resolve a target that is relative to its folder.
    """
    tags = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)))
    attribute = lambda name: F.nullif(F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), F.lit(""))
    href = F.when(F.col("tag").rlike("(?i)^<link"), attribute("href")).otherwise(attribute("url"))
    named = (
        pages.select("url", "html").where("url is not null and html is not null")
        .select("url", F.explode(tags).alias("tag"))
        .select("url", F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href")).where("href is not null"))
    return (named.select(_key(F.col("url")).alias("a"), _resolved(F.col("href"), F.col("url")).alias("target")).where("target is not null")
            .select("a", _key(F.col("target")).alias("b"), "target"))


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of ``pages`` (page_id, url, html).

    A page that a rule fits has that rule's verdict, whatever its aliases are. Another page is blocked when an alias is
    blocked by a rule and no alias is allowed by one; else it is allowed. ``component`` is the least key of its aliases
    (null without any). Null or malformed urls have an empty host and path, fit no rule and are allowed; repeated rows
    stay; an empty table gives no rows; other columns are ignored. Pages are joined with aliases only: the links, one
    row for each tag, go through the component search and are never collected.
    """
    pages = pages.select("page_id", "url", "html")
    links = cut_lineage(alias_links(pages).distinct())
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _key(F.col("url")).alias("key"))
    judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule",
                             F.coalesce(verdict_of(F.col("rule"), rules), F.lit("allow")).alias("verdict"),
                             F.lit(None).cast("string").alias("component"))
    members = cut_lineage(components(links))
    # The key starts with host and path, so a target that is no page of the table is judged by its own url.
    ends = members.withColumn("url", F.concat(F.lit("x://"), "id"))
    decided = ends.withColumn("own", verdict_of(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules), rules))
    spread = decided.groupBy("component").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    aliases = members.join(spread, "component").select(
        F.col("id").alias("key"), "component",
        F.when(F.col("blocked") & ~F.coalesce("allowed", F.lit(False)), "block").otherwise("allow").alias("spread"))
    return judged.join(aliases, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(verdict_of(F.col("rule"), rules), "spread", F.lit("allow")).alias("verdict"), "component")
