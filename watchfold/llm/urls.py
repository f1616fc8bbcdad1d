"""URL filter with redirect equivalence. DataFrame functions only.

Rules are rows (host, path, verdict). A rule fits its host and all subdomains when the URL's path starts with the rule's
path; of fitting rules the longest host and path together wins (the greater text on a tie), and the page gets its verdict.

Aliases: the node of a URL is its host, path and query (scheme and fragment drop out). A page's node is linked with the node of its
canonical link and of its meta refresh target. Connected components of these links are groups of aliases. A page without
a fitting rule is allowed when a node of its component fits an allow rule, else blocked when one fits a block rule, else allowed.

Rules meet hosts by an equi join on host suffixes, as many as the rule with the most labels has; a rule table below Spark's broadcast
limit is broadcast. Pages carry only host, path and node through the one shuffle; components run on link
ends alone.

Edge cases: a URL that is null or has no `://` has empty host, path and node, fits no rule and has no aliases. A null html has no links.
Link targets that are relative are resolved against the page; empty ones and other schemes (mailto:, javascript:) are no links. Rules with
null or empty host or a verdict other than allow or block are left out; a null path is empty. Repeated rows and null page_ids are
judged each. Empty tables give an empty result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.llm.registry import query, table
from watchfold.operators.graph import connected_components

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = "(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
TAG = "(?i)<(?:link|meta)\\s[^<>]*>"
CANONICAL = "(?i)\\srel\\s*=\\s*[\"']?canonical[\"'\\s/>]"
REFRESH = "(?i)\\shttp-equiv\\s*=\\s*[\"']?refresh[\"'\\s/>]"
HREF = "(?i)\\shref\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
REFRESH_URL = "(?i)\\scontent\\s*=\\s*[\"']?[^\"'>]*?url\\s*=\\s*['\"]?([^\"'>\\s]+)"


def inline_rules(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given in the program as a local relation."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def part(url: Column, group: int) -> Column:
    """Host (1, A-Z lower-cased), path (2) or query (3) of a URL; empty without `://`."""
    found = F.coalesce(F.regexp_extract(url.cast("string"), URL, group), F.lit(""))
    return F.translate(found, UPPER, LOWER) if group == 1 else found


def node(url: Column) -> Column:
    return F.concat(part(url, 1), part(url, 2), part(url, 3))


def link_targets(url: Column, html: Column) -> Column:
    """Absolute URLs that the page's canonical link and refresh point to."""
    tags = F.regexp_extract_all(html, F.lit(TAG), F.lit(0))
    href = lambda t: F.concat(F.regexp_extract(t, HREF, 1), F.regexp_extract(t, HREF, 2), F.regexp_extract(t, HREF, 3))
    target = lambda t: F.when(F.regexp_like(t, F.lit(CANONICAL)), href(t)).when(F.regexp_like(t, F.lit(REFRESH)), F.regexp_extract(t, REFRESH_URL, 1)).otherwise("")
    raw = F.filter(F.transform(tags, lambda t: F.replace(F.trim(target(t)), F.lit("&amp;"), F.lit("&"))), lambda t: t != "")
    host = F.concat(F.lit("http://"), part(url, 1))
    folder = F.regexp_extract(part(url, 2), "(?s)^(.*/)", 1)
    resolved = lambda t: (F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
                          .when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(host, t))
                          .when(t.startswith("#") | t.startswith("?"), F.concat(host, part(url, 2), t))
                          .otherwise(F.concat(host, F.when(folder == "", F.lit("/")).otherwise(folder), t)))
    some = F.coalesce(F.regexp_like(html, F.lit("(?i)canonical|http-equiv")), F.lit(False))
    return F.when(some, F.filter(F.transform(raw, resolved), lambda t: t.isNotNull())).otherwise(F.array().cast("array<string>"))


def matched(rows: DataFrame, rules: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each row of `rows` (host, path and `carried`): the winning rule's text and verdict, or nulls."""
    clean = rules.where("host <> '' AND verdict IN ('allow', 'block')").select(
        F.translate("host", UPPER, LOWER).alias("__host"), F.coalesce("path", F.lit("")).alias("__path"), F.col("verdict").alias("__verdict"))
    labels = clean.agg(F.max(F.size(F.split("__host", "\\."))).alias("n")).first()["n"] or 1
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    each = rows.withColumn("__uid", F.monotonically_increasing_id()).withColumn("__suffix", F.explode(suffixes))
    met = each.join(clean, (F.col("__suffix") == F.col("__host")) & F.startswith("path", F.col("__path")), "left")
    text = F.concat("__host", "__path")
    best = F.max(F.when(F.col("__host").isNotNull(), F.struct(F.length(text).alias("n"), text.alias("rule"), F.col("__verdict").alias("verdict"))))
    kept = ["host", "path", *carried]
    return met.groupBy("__uid").agg(*[F.first(c).alias(c) for c in kept], best.alias("__best")).select(*kept, "__best.rule", F.col("__best.verdict").alias("rule_verdict"))


def alias_decisions(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, alias_verdict) for the nodes of all links: the decision of their component, null without a fitting rule."""
    ends = pages.select(node(F.col("url")).alias("src"), F.explode(link_targets(F.col("url"), F.col("html").cast("string"))).alias("target"))
    links = ends.select("src", node(F.col("target")).alias("dst")).where("src <> '' AND dst <> ''")
    labels = connected_components(links)
    parts = labels.select("node", "component", F.regexp_extract("node", "(?s)^([^/?]*)", 1).alias("host"), F.regexp_extract("node", "(?s)^[^/?]*([^?]*)", 1).alias("path"))
    ruled = matched(parts, rules, ["node", "component"])
    allow, block = F.max(F.col("rule_verdict") == "allow"), F.max(F.col("rule_verdict") == "block")
    decided = ruled.groupBy("component").agg(F.when(allow, "allow").when(block, "block").alias("alias_verdict")).where("alias_verdict IS NOT NULL")
    return labels.join(decided, "component").select("node", "alias_verdict")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page."""
    rows = pages.select("page_id", part(F.col("url"), 1).alias("host"), part(F.col("url"), 2).alias("path"), node(F.col("url")).alias("node"))
    ruled = matched(rows, rules, ["page_id", "node"])
    found = ruled.join(alias_decisions(pages, rules), "node", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict"))


def urls_sql(rules=RULES) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    q = lambda pattern: pattern.replace("'", "''")
    href = " || ".join(f"coalesce(regexp_extract(t, '{q(HREF)}', {k}), '')" for k in (1, 2, 3))
    cut = lambda c, k: (f"translate(coalesce(regexp_extract({c}, '{URL}', 1), ''), '{UPPER}', '{LOWER}')" if k == 1 else f"coalesce(regexp_extract({c}, '{URL}', {k}), '')")
    node_of = lambda c: f"({cut(c, 1)} || {cut(c, 2)} || {cut(c, 3)})"
    best = lambda host, path: f"""(SELECT arg_max(verdict || ' ' || rh || rp, (length(rh || rp), rh || rp)) FROM rules
        WHERE ({host} = rh OR ends_with({host}, '.' || rh)) AND starts_with({path}, rp))"""
    return f"""
WITH RECURSIVE rules(rh, rp, verdict) AS (VALUES {values}),
p AS (SELECT page_id, url, {cut('url', 1)} AS host, {cut('url', 2)} AS path, {node_of('url')} AS node, coalesce(html, '') AS html FROM pages),
tags AS (SELECT node, host, path, unnest(regexp_extract_all(html, '{TAG}', 0)) AS t FROM p WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
raw AS (SELECT node, host, path, replace(trim(CASE WHEN regexp_matches(t, '{q(CANONICAL)}') THEN {href}
    WHEN regexp_matches(t, '{q(REFRESH)}') THEN regexp_extract(t, '{q(REFRESH_URL)}', 1) ELSE '' END), '&amp;', '&') AS t FROM tags),
resolved AS (SELECT node, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t
    WHEN starts_with(t, '#') OR starts_with(t, '?') THEN 'http://' || host || path || t
    ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || t END AS target FROM raw),
links AS (SELECT node AS a, {node_of('target')} AS b FROM resolved WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM links WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM links WHERE a <> '' AND b <> '' AND a <> b),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
ends AS (SELECT DISTINCT b, regexp_extract(b, '(?s)^([^/?]*)', 1) AS host, regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach),
ruled AS (SELECT b, split_part({best('host', 'path')}, ' ', 1) AS verdict FROM ends),
alias AS (SELECT reach.a AS node, max(ruled.verdict = 'allow') AS allow, max(ruled.verdict = 'block') AS block FROM reach JOIN ruled USING (b) GROUP BY 1),
judged AS (SELECT p.*, {best('host', 'path')} AS own FROM p)
SELECT page_id, host, path, split_part(own, ' ', 2) AS rule,
    coalesce(split_part(own, ' ', 1), CASE WHEN alias.allow THEN 'allow' WHEN alias.block THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN alias ON judged.node = alias.node"""


@query("op7_urls", urls_sql())
def op7_urls(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"), inline_rules(spark))
