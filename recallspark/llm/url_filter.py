"""URL filter with redirect equivalence, in DataFrame operations only.

A url gets the verdict of the longest rule (host and path prefix) that fits it. Canonical links and
refresh redirects inside the pages, and a table of logged redirects where there is one, are edges
between urls; the connected components of these edges are aliases of each other. A url without a
rule of its own is blocked when a block rule fits one of its aliases and no allow rule fits any; an
own rule always comes first.

Urls that differ in their scheme or fragment only are one node. Targets without a scheme are resolved
against the url they are found at, and all canonical links and refreshes of a page count. Defined cases: a null url or one
without ``://`` has an empty host and path, fits no rule and is allowed; repeated rows get a row
each; pages without html have no edges; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, stored
from .components import connected_components

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node(url: Column) -> Column:
    """Host, path and query; null for what is no absolute url."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host(url), F.regexp_extract(url, URL, 2), F.regexp_extract(url, URL, 3)))


def plain_path(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, s: (
        F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))))
    end = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.concat(F.lit("/"), F.array_join(end, "/"))).otherwise(path)


def resolved(url: Column, target: Column) -> Column:
    """``target`` as found at ``url``, as an absolute url; null for what leads to no page."""
    here, base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, URL, 2)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (F.when(target == "", None).when(F.rlike(target, F.lit(ABSOLUTE)), target)
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
            .when(F.rlike(target, F.lit(SCHEME)) | (here == ""), None)
            .when(F.startswith(target, F.lit("/")), F.concat(here, plain_path(own), rest))
            .when(F.startswith(target, F.lit("#")), url)
            .when(F.startswith(target, F.lit("?")), F.concat(here, base, rest))
            .otherwise(F.concat(here, plain_path(F.concat(folder, own)), rest)))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, rule) with rules like ``example.org/es/``."""
    rows = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in rules))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with host and path) and the longest rule that fits: rule, action.

    Each distinct host meets the rules of its own name and of the domains above it; a host's rules are
    written as one row and meet its urls in a join of their own, whose large partitions can be split.
    """
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    names = urls.select("host").where("host <> ''").distinct().withColumn("name", F.explode(above))
    split = rules.select("rule", "action", F.regexp_extract("rule", "^[^/]*", 0).alias("name"),
                         F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("start"))
    fitting = names.join(split, "name").groupBy("host").agg(
        F.collect_list(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "start")).alias("fit"))
    out = urls.join(stored(fitting, "hosts"), "host", "left")
    best = F.array_max(F.filter("fit", lambda r: F.startswith(F.col("path"), r["start"])))
    return out.withColumn("__best", best).select(
        *urls.columns, F.col("__best.rule").alias("rule"),
        F.when(F.col("__best.allow"), "allow").when(~F.col("__best.allow"), "block").alias("action"))


def alias_edges(pages: DataFrame, url_col: str, html_col: str, redirects: DataFrame | None) -> DataFrame:
    """(a, b) nodes that a canonical link, a refresh or a logged redirect connects."""
    targets = F.array_distinct(F.concat(*(F.regexp_extract_all(html_col, F.lit(p), 1) for p in (CANONICAL, REFRESH))))
    tagged = F.contains(F.lower(html_col), F.lit("canonical")) | F.contains(F.lower(html_col), F.lit("http-equiv"))
    found = pages.where(tagged).select(F.col(url_col).alias("url"), F.explode(targets).alias("target"))
    edges = found.select(node(F.col("url")).alias("a"), node(resolved(F.col("url"), F.col("target"))).alias("b"))
    if redirects is not None:
        a, b = redirects.columns
        edges = edges.unionByName(redirects.select(node(F.col(a)).alias("a"), node(resolved(F.col(a), F.col(b))).alias("b")))
    return edges


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id",
                url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict."""
    roots = connected_components(alias_edges(pages, url_col, html_col, redirects))
    nodes = judge(roots.withColumn("host", F.regexp_extract("node", "(?s)^([^/?]*)", 1))
                  .withColumn("path", F.regexp_extract("node", "(?s)^[^/?]*([^?]*)", 1)), rules)
    spread = nodes.groupBy("root").agg(F.max(F.col("action") == "block").alias("blocked"), F.max(F.col("action") == "allow").alias("allowed"))
    spread = spread.where("blocked and not coalesce(allowed, false)").select("root")
    blocked = roots.join(spread, "root", "left_semi").select("node", F.lit(True).alias("alias_blocked"))
    urls = pages.select(id_col, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), node(F.col(url_col)).alias("node"))
    out = judge(urls, rules).join(blocked, "node", "left")
    verdict = F.coalesce("action", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"))
