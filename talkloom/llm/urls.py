"""URL filters with redirect equivalence.

Rules name a host and a path prefix and allow or block. Pages that redirect to each
other, or name each other as canonical, are the same page under several addresses;
an address that no rule fits takes over what its aliases were judged.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.llm.components import components
from talkloom.operators.lookup import lookup

ALLOW, BLOCK = "allow", "block"

#: Where a page says that it stands for, or leads to, another address.
_LINKS = (
    r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']?og:url\b)[^>]*?\bcontent\s*=\s*["']?([^"'\s>]+)""",
    r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>;]+)""",
)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def _lower(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; empty for null or without ``://``."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule, host_column: str, path_column: str) -> Column:
    h, named = F.col(host_column), rule.host.lower()
    return ((h == named) | h.endswith("." + named)) & F.col(path_column).startswith(rule.path)


def matched(rules: list[Rule], host_column: str, path_column: str) -> Column:
    """The longest rule that fits as (rule, verdict); on equal length an allow, then the first by name. Null if none."""
    ranked = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != ALLOW, r.host + r.path))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ranked):
        found = F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(_fits(rule, host_column, path_column), found).otherwise(chosen)
    return chosen


def address(url: Column) -> Column:
    """Host and path without a final slash: what tells two pages apart. Null where there is no host."""
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), r"/+$", "")))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments carried out; a final slash may be lost."""
    step = lambda done, part: (
        F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part))))
    return F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/")


def _resolved(link: Column, host_column: str, path_column: str) -> Column:
    """A link as a whole URL, without the query of relative ones: a scheme at its start makes it absolute, all others
    are completed by the page's scheme, host and directory. Null for schemes without ``//``, as in ``mailto:x``.
    """
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    bare = F.regexp_extract(link, r"^[^?#]*", 0)
    at_host = lambda path: F.concat(F.lit("https://"), F.col(host_column), path)
    directory = F.concat(F.lit("/"), F.regexp_extract(path_column, r"(?s)^/(.*/)?", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(bare == "", at_host(F.col(path_column)))
        .when(link.startswith("/"), at_host(_without_dots(bare)))
        .otherwise(at_host(_without_dots(F.concat(directory, bare))))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target: the addresses joined by canonical links, og:url and immediate redirects in the pages' HTML."""
    marked = pages.where(F.lower(html).rlike("canonical|og:url|refresh")).select(
        address(F.col(url)).alias("source"), host(F.col(url)).alias("own"), path(F.col(url)).alias("at"),
        F.explode(F.array(*[F.regexp_extract(html, pattern, 1) for pattern in _LINKS])).alias("link"))
    linked = marked.where("link <> ''").select("source", address(_resolved(F.col("link"), "own", "at")).alias("target"))
    return linked.where("source IS NOT NULL AND target IS NOT NULL AND source <> target").distinct()


def judge(pages: DataFrame, rules: list[Rule], links: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and alias_group for every page.

    A rule that fits a page decides. Otherwise the page's group decides: all addresses
    connected by ``links`` (source, target), and all pages of one address. One allow in
    the group allows, even if others are blocked; else one block blocks; a group without
    either is allowed. Link targets that are no page are judged by the rules too. Null
    and malformed URLs have an empty host, fit no rule, belong to no group and are allowed.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select(
        "page_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"),
        address(F.col("_url")).alias("address"))
    judged = judged.withColumn("_rule", matched(rules, "host", "path"))
    group = components(links, "source", "target", "url_aliases")

    # What is known about each address: from its pages, or from the link alone.
    full = F.concat(F.lit("https://"), F.col("address"), F.when(F.col("address").contains("/"), "").otherwise("/"))
    targets = links.select(F.explode(F.array("source", "target")).alias("address")).distinct().select(
        "address", host(full).alias("host"), path(full).alias("path"))
    votes = judged.where("address IS NOT NULL").select("address", F.col("_rule.verdict").alias("verdict")).unionByName(
        targets.select("address", matched(rules, "host", "path")["verdict"].alias("verdict"))
    ).where("verdict IS NOT NULL")
    # Allow sorts before block, so that the smallest verdict is the one that counts.
    votes = votes.groupBy("address").agg(F.min("verdict").alias("verdict"))
    grouped = lookup(votes, group.select(F.col("node").alias("address"), "component"), "address").groupBy(
        F.coalesce("component", "address").alias("component")).agg(F.min("verdict").alias("group_verdict"))
    placed = lookup(judged, group.select(F.col("node").alias("address"), "component"), "address").withColumn(
        "alias_group", F.coalesce("component", "address")).drop("component")
    found = lookup(placed, grouped.withColumnRenamed("component", "alias_group"), "alias_group")
    return found.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.col("group_verdict"), F.lit(ALLOW)).alias("verdict"), "alias_group")
