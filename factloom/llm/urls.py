"""URL filters: rules by host and path, and block decisions that pass along redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import LOWER, UPPER, durable
from factloom.llm.components import connected_components

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. The rules become one CASE, longest first."""
    out: Column | None = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def alias_key(url: Column) -> Column:
    """Host, path and query: the scheme and the fragment don't tell pages apart. Null where there is no host."""
    key = F.concat(host_of(url), F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"\A[^/?#]*([^#]*)", 1))
    return F.when(host_of(url) != "", key)


def links_of(html: Column) -> Column:
    """Targets of canonical links and of redirects by meta refresh, as written, in an array."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    canonical = lambda t: F.when(t.rlike(r"(?is)\A<link\b.*\brel\s*=\s*[\"']?canonical\b"), F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = lambda t: F.when(t.rlike(r"(?is)\A<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(t, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1))
    found = F.transform(tags, lambda t: F.coalesce(canonical(t), refresh(t)))
    return F.transform(F.filter(found, lambda x: x.isNotNull() & (x != "")), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def resolved(base: Column, target: Column) -> Column:
    """The target as an absolute url, by the base's scheme, host or folder."""
    scheme = F.substring_index(base, "://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_extract(path_of(base), r"\A(.*/)", 1)
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component and via of every page.

    A page with a rule has its verdict. Another takes the decisions in its class of aliases: allow if any alias is
    expressly allowed, else block if any is blocked, else allow; ``via`` says which (rule, alias or default). Aliases are
    pages joined by canonical links, meta refreshes and the optional table ``redirects`` (u, v: urls), through any number
    of steps and through urls that are no page here. Null or unreadable urls have no alias and are allowed by default.
    Null and empty pages have no links. Repeated rows are judged alike; ties of rules of one length go to the first in order.
    Other columns are ignored; an empty table gives none."""
    p = pages.select("page_id", "url", "html")
    p = p.select("page_id", "url", alias_key(F.col("url")).alias("key"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    named = p.filter("key IS NOT NULL AND html IS NOT NULL").select("url", F.explode(links_of(F.col("html"))).alias("target"))
    links = named.select("url", resolved(F.col("url"), F.col("target")).alias("to"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("u").alias("url"), F.col("v").alias("to")))
    edges = links.select(alias_key(F.col("url")).alias("u"), alias_key(F.col("to")).alias("v")).filter("u != v").distinct()
    classes = connected_components(edges)
    at = classes.select("node", "component", rule_of(F.regexp_extract("node", r"\A([^/?#]*)", 1), F.regexp_extract("node", r"\A[^/?#]*([^?#]*)", 1), rules)["verdict"].alias("v"))
    flags = at.groupBy("component").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    alias = durable(at.join(flags, "component").select(F.col("node").alias("key"), "component", "allowed", "blocked"))
    own = rule_of(F.col("host"), F.col("path"), rules)
    # pages without a key meet no alias, as no host begins with a question mark; their ids spread them
    judged = p.select("page_id", F.coalesce("key", F.concat(F.lit("?"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("key"), "host", "path", own.alias("own"))
    judged = judged.select("*", F.lit(None).cast("string").alias("component"), F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("boolean").alias("blocked")) if alias.isEmpty() else judged.join(alias, "key", "left")
    passed = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    return judged.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", passed, F.lit("allow")).alias("verdict"),
        "component",
        F.when(F.col("own").isNotNull(), "rule").when(passed.isNotNull(), "alias").otherwise("default").alias("via"),
    )
