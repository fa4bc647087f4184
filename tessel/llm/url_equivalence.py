"""URL filters: block decisions spread over redirects and canonical links.

Rules of host and path judge each URL; the longest that fits wins. Redirects and canonical links between URLs are edges, and
connected components over them (distributed, by star contraction) are sets of aliases. An alias without a rule of its own is
blocked if its component holds a blocked URL and no explicitly allowed one; a rule of its own always stands. All of this is
DataFrame functions.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skew_join, table
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """Fits host and all its subdomains, where the path starts with path."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return f"{self.host}{self.path}"


RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first ://, up to / ? # or the end, A-Z lower-cased; path: from there up to ? or #. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(str(r)), len(r.host), r.verdict == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(str(r)).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _targets(html: Column) -> Column:
    """What a page's canonical links and refresh redirects point to."""
    quoted = lambda tag, test, attr: F.flatten(
        F.transform(
            F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), 0), lambda t: t.rlike(test)),
            lambda t: F.regexp_extract_all(t, F.lit(attr), 1),
        )
    )
    canonical = quoted("link", r"(?is)\brel\s*=\s*[\"']?canonical\b", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    redirect = quoted("meta", r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    return F.concat(canonical, redirect)


def resolved(base: Column, target: Column) -> Column:
    """A link's target as an absolute URL, by the page's URL base; null for other schemes, bare fragments and a base without ://."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    _, path = host_and_path(base)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    steps = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own)), "/", -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda up, s: F.when(s == ".", up).when(s == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(1)))).otherwise(F.concat(up, F.array(s))),
    )
    kept = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    relative = (
        F.when(target.startswith("//"), F.concat(scheme, target))
        .when(own != "", F.concat(site, F.array_join(kept, "/"), rest))
        .when(rest.startswith("?"), F.concat(site, path, rest))
    )
    absolute = target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    return F.when(absolute, target).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (F.instr(base, "://") > 0), relative)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of redirects and canonical links, without fragments; relative targets are resolved against the page's URL."""
    has = F.col("html").rlike(r"(?i)canonical|http-equiv")  # a cheap test before the tags are looked at
    rows = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull() & has)
    rows = rows.select("url", F.explode(_targets(F.col("html"))).alias("target"))
    rows = rows.withColumn("target", resolved(F.col("url"), F.col("target"))).where(F.col("target").isNotNull())
    return rows.select(address(F.col("url")).alias("url"), address(F.col("target")).alias("target")).where("url <> target").distinct()


def address(url: Column) -> Column:
    """What tells URLs apart: the URL without its fragment, A-Z of the host lower-cased, & for the reference to it."""
    plain = F.replace(F.regexp_replace(url, r"(?s)#.*$", ""), F.lit("&amp;"), F.lit("&"))
    host, _ = host_and_path(plain)
    at = F.instr(plain, "://")
    return F.when(at > 0, F.concat(F.lower(F.substring(plain, F.lit(1), at + 2)), host, F.substring(plain, at + 3 + F.length(host), F.length(plain)))).otherwise(plain)


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: list[Rule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages(page_id, url, html).

    edges(url, target) may add aliases from elsewhere (redirect logs) to those of the pages; targets need not be pages. Rows
    that no rule and no component judges get default. A null url has an empty host and path, no aliases and no rule.
    """
    found = alias_edges(pages)
    if edges is not None:
        found = found.unionByName(edges.select(address(F.col("url")).alias("url"), address(F.col("target")).alias("target")))
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edge_nodes = found.select(F.col("url").alias("u"), F.col("target").alias("v"))
    of = connected_components(edge_nodes, kind="string")
    node_host, node_path = host_and_path(F.col("node"))
    verdicts = of.select("node", "component", rule_of(node_host, node_path, rules)["verdict"].alias("verdict"))
    spread = verdicts.groupBy("component").agg(
        F.when(F.max(F.col("verdict") == "allow"), "allow").when(F.max(F.col("verdict") == "block"), "block").alias("spread")
    )
    aliases = skew_join(verdicts, spread, "component").where("verdict is null and spread is not null").select(F.col("node").alias("_address"), "spread")
    open_rows = judged.where("own is null").withColumn("_address", address(F.col("url")))
    nowhere = open_rows.where(F.col("_address").isNull()).withColumn("spread", F.lit(None).cast("string"))
    reached = skew_join(open_rows.where(F.col("_address").isNotNull()), aliases, "_address", "left").unionByName(nowhere).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("spread", F.lit(default)).alias("verdict"))
    return judged.where("own is not null").select("page_id", "host", "path", "own.rule", "own.verdict").unionByName(reached)


def op4_url_equivalence(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql_rule(host: str, path: str, what: str) -> str:
    """The longest fitting rule's name or verdict as a SQL CASE."""
    ordered = sorted(RULES, key=lambda r: -len(str(r)))
    cases = [
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r if what == 'rule' else r.verdict}'"
        for r in ordered
    ]
    return f"CASE {' '.join(cases)} END"


_SQL_HOST = "translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = "regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1)"
_SQL_REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
_SQL_ADDRESS = """CASE WHEN instr({0}, '://') > 0 THEN lower(substr({0}, 1, instr({0}, '://') + 2))
  || translate(regexp_extract(substr({0}, instr({0}, '://') + 3), '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || regexp_extract(substr({0}, instr({0}, '://') + 3), '(?s)^[^/?#]*(.*)$', 1) ELSE {0} END"""
_SQL_BARE = "replace(regexp_replace({0}, '(?s)#.*$', ''), '&amp;', '&')"

OP4_SQL = f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, coalesce({_SQL_REST.format("url")}, '') AS rest, {_SQL_BARE.format("url")} AS bare FROM pages
), q AS (
  SELECT page_id, html, url, {_SQL_HOST} AS host, {_SQL_PATH} AS path, {_SQL_ADDRESS.format("bare")} AS address FROM p
), t AS (
  SELECT address, url, path, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM q WHERE address IS NOT NULL
), g AS (
  SELECT address, url, path, CASE
    WHEN regexp_matches(tag, '(?is)^<link') AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta') AND regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  END AS target FROM t
), r AS (
  SELECT *, regexp_extract(target, '^([^?#]*)', 1) AS own, regexp_extract(target, '^[^?#]*(.*)$', 1) AS rest FROM g WHERE target IS NOT NULL
), o AS (
  SELECT *, string_split(CASE WHEN starts_with(own, '/') THEN own ELSE coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || own END, '/') AS steps FROM r
), w AS (
  SELECT *, list_reduce(list_transform(steps, lambda s: [s]), lambda up, s: CASE WHEN s[1] = '.' THEN up WHEN s[1] = '..' THEN up[1:greatest(len(up) - 1, 1)] ELSE up || s END) AS kept FROM o
), x AS (
  SELECT address, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN target
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.\\-]*:') OR instr(url, '://') = 0 THEN NULL
    WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    WHEN own <> '' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || array_to_string(CASE WHEN steps[-1] IN ('.', '..') THEN kept || [''] ELSE kept END, '/') || rest
    WHEN starts_with(rest, '?') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || rest
  END AS target FROM w
), h AS (
  SELECT address, {_SQL_BARE.format("target")} AS target FROM x WHERE target IS NOT NULL
), e AS (
  SELECT DISTINCT address AS u, {_SQL_ADDRESS.format("target")} AS v FROM h
), b AS (
  SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v
), c AS (
  SELECT u AS node, u AS other FROM b UNION SELECT c.node, b.v FROM c JOIN b ON c.other = b.u
), n AS (
  SELECT node, {_sql_rule(_SQL_HOST, _SQL_PATH, "verdict")} AS verdict
  FROM (SELECT DISTINCT c.node, c.other, {_SQL_REST.format("c.other")} AS rest FROM c)
), s AS (
  SELECT node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS spread FROM n GROUP BY node
)
SELECT q.page_id, q.host, q.path, {_sql_rule("q.host", "q.path", "rule")} AS rule,
       coalesce({_sql_rule("q.host", "q.path", "verdict")}, s.spread, 'allow') AS verdict
FROM q LEFT JOIN s ON q.address = s.node
"""
