"""URL filters with redirect equivalence.

A rule is a host and a path prefix; it fits its host and all subdomains, and the longest fitting rule decides. Pages that no rule fits
take the decision of their aliases: connected components over redirect and canonical-link edges, among which one blocked url
blocks the rest. An explicit allow of a page's own url takes precedence over whatever its aliases say.

Urls are compared as written. Nodes are 128-bit digests of urls, so edges stay small whatever the urls' length.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchrank.llm.common import components, packed, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 1000  # rules are one literal of the plan; a longer list must be split


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(size, name, verdict) of the longest rule that fits, ties by name; null if none does.

    The rules are one literal map from a host to its rules, looked up by the last labels of ``host``, as many as a rule's host has at most:
    the expression's size does not depend on the number of rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size: int, name: string, verdict: string>")
    by_host: dict[str, list] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append({"size": len(r.name), "name": r.name, "verdict": r.verdict, "path": r.path})
    table = F.from_json(F.lit(json.dumps(by_host)), "MAP<STRING, ARRAY<STRUCT<size: INT, name: STRING, verdict: STRING, path: STRING>>>")
    tails = [F.substring_index(host, ".", k) for k in range(-max(h.count(".") + 1 for h in by_host), 0)]
    found = F.flatten(F.transform(F.array_distinct(F.array(*tails)), lambda h: F.coalesce(F.try_element_at(table, h), F.array())))
    fits = F.filter(found, lambda r: path.startswith(r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))))


def resolved(target: Column, url: Column) -> Column:
    """Absolute form of a link target found in the page of ``url``; fragments stay."""
    target = F.regexp_replace(F.trim(target), "&amp;", "&")
    site = F.regexp_extract(url, r"^[^:]*://[^/?#]*", 0)
    return (F.when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^[^:]*:", 0), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target != "", F.concat(site, F.regexp_extract(F.concat(path_of(url), F.lit("")), r"^(.*/)?", 0), target)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target) urls of canonical links and of redirects by refresh."""
    html = F.col("html")
    link = F.regexp_extract(html, r"""(?i)<link\b(?=[^>]*\brel=["']?canonical\b)[^>]*\bhref=["']?([^"'\s>]+)""", 1)
    moved = F.regexp_extract(html, r"""(?i)<meta\b(?=[^>]*\bhttp-equiv=["']?refresh\b)[^>]*\bcontent=["']?[^"'>]*?url=\s*["']?([^"'>]+)""", 1)
    found = F.filter(F.array(link, moved), lambda x: x != "")
    rows = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.explode(found).alias("found"))
    return rows.select(F.col("url").alias("source"), resolved(F.col("found"), F.col("url")).alias("target")).where("target IS NOT NULL")


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node) of every url that shares a component with a blocked one."""
    ends = edges.select(F.col("source").alias("url")).union(edges.select(F.col("target").alias("url"))).distinct()
    parts = ends.select(F.md5("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parts.select("node", (rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block").alias("bad"))
    found = components(edges.select(F.md5("source").alias("a"), F.md5("target").alias("b")), "url-aliases", kind="STRING")
    bad = judged.where("bad").join(found, "node").select("component").distinct()
    return found.join(bad, "component").select("node").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``redirects`` (source, target) adds observed redirects to what the pages say. A null url, or one without ://, has no host, no path, no
    rule and no aliases. Repeated pages get equal verdicts. Columns of ``pages`` with these names are replaced.
    """
    url = F.col("url").cast("string")
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target"))
    bad = blocked_aliases(edges.where("source IS NOT NULL AND target IS NOT NULL"), rules).withColumn("_bad", F.lit(True))
    rows = packed(pages, F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), F.md5(url).alias("at"))
    joined = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).join(bad, F.col("at") == F.col("node"), "left")
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("_bad"), F.lit("block")), F.lit("allow"))
    return unpacked(joined, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("hit.name"), verdict=verdict)


def verdicts(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    return judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def allowed(pages: DataFrame, **options) -> DataFrame:
    """The rows of ``pages`` that are not blocked."""
    rows = packed(pages, "url", "html")
    return unpacked(judge(rows, **options).where("verdict = 'allow'"), pages.columns)
