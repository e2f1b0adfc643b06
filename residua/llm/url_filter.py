"""URL rules whose decisions reach aliases: urls tied by redirects and canonical links.

A url gets the longest rule for its host or a parent domain whose path it starts with.  A url without
a rule takes the decision of its aliases: the connected component over redirect and canonical-link
edges.  An explicit allow in the component outranks blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.components import connected_components
from residua.session import durable

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """What servers commonly redirect to: no scheme, ``www.``, default port, trailing slashes, tracking
    parameters or fragment.  Null for urls without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _tag_targets(html: Column, tag: str, marked: str, target: str) -> Column:
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)(<{tag}\b[^>]*>)"))
    return F.transform(F.filter(tags, lambda t: t.rlike(marked)), lambda t: F.regexp_extract(t, target, 1))


def page_links(url: Column, html: Column) -> Column:
    """Urls that a page names as itself: canonical links and immediate redirects."""
    found = F.concat(
        F.coalesce(_tag_targets(html, "link", r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhref\s*=\s*["']?([^"'>\s]+)"""), F.array().cast("array<string>")),
        F.coalesce(_tag_targets(html, "meta", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b""", r"""(?i)\burl\s*=\s*([^"'>\s]+)"""), F.array().cast("array<string>")),
    )
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    full = F.transform(found, lambda t: F.when(t.startswith("/") & ~t.startswith("//"), F.concat(base, t)).when(t.startswith("//"), F.concat(F.lit("http:"), t)).otherwise(t))
    return F.filter(full, lambda t: F.instr(t, "://") > 0)


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """For every host with rules, those of itself and its parent domains."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    entry = F.struct(F.length("rule").alias("size"), F.col("allow"), F.col("rule_path"), F.col("rule"))
    return (
        hosts.select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
        .groupBy("host").agg(F.collect_set(entry).alias("__rules"))
    )


def judge_urls(
    pages: DataFrame, rules: list[Rule] | DataFrame, key: str = "page_id", url: str = "url", html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """One row (key, host, path, rule, verdict, component) per page.

    ``rules``: a list, or a table (rule_host, rule_path, allow).  ``redirects``: optional further edges
    (src, dst) between urls.  Of equally long rules an allow wins.  Null urls and urls without ``://``
    have empty host and path, no rule, no alias, and are allowed.  Repeated pages are judged alike; an
    empty table gives no rows.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame([(r.host, r.path, r.allow) for r in rules], "rule_host string, rule_path string, allow boolean")
    rules = rules.select("rule_host", "rule_path", "allow", F.concat("rule_host", "rule_path").alias("rule"))
    links = page_links(F.col(url), F.col(html)) if html else F.array().cast("array<string>")
    parsed = pages.select(
        F.col(key).alias("__key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), canonical(F.col(url)).alias("alias"),
        F.transform(links, canonical).alias("links"),
    )
    parsed = durable(parsed)
    known = _host_rules(parsed.select("host").where("host <> ''").distinct(), rules).select(F.struct("host").alias("__host"), "__rules")
    best = F.array_max(F.filter("__rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    ruled = (
        parsed.withColumn("__host", F.struct("host")).join(known, "__host", "left")
        .select("__key", "host", "path", "alias", "links", best.alias("b"))
        .select("__key", "host", "path", "alias", "links", F.col("b.rule").alias("rule"), F.col("b.allow").alias("allow"))
    )
    ruled = durable(ruled)
    edges = ruled.select(F.col("alias").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(canonical(F.col("src")).alias("a"), canonical(F.col("dst")).alias("b")))
    tied = connected_components(edges.where("a <> b").distinct()).select(F.struct(F.col("node").alias("alias")).alias("__alias"), "component")
    placed = (
        ruled.withColumn("__alias", F.struct("alias")).join(tied, "__alias", "left")
        .select("__key", "host", "path", "rule", "allow", F.coalesce("component", "alias").alias("component"))
    )
    decided = placed.where("component IS NOT NULL AND allow IS NOT NULL").groupBy("component").agg(F.max("allow").alias("any_allow"))
    decided = decided.select(F.struct("component").alias("__component"), "any_allow")
    verdict = F.when(F.coalesce("allow", "any_allow", F.lit(True)), "allow").otherwise("block")
    return placed.withColumn("__component", F.struct("component")).join(decided, "__component", "left").select(
        F.col("__key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "component"
    )
