"""URL filter with redirect equivalence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a URL shows (fixed values).
TRACKING = r"utm_[a-z]+|fbclid|gclid|ref"
#: The rules of the registered query (fixed values): verdict, host and path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null or without it."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_form(url: Column) -> Column:
    """Host, path and query without scheme, fragment, tracking parameters and a last slash; null without ``://``.

    Two URLs of one form are the same node of the redirect graph.
    """
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^(?:{TRACKING})(?:=|$)")), "&")
    form = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.locate("://", url) > 0, form)


def link_targets(html: Column) -> Column:
    """Raw targets of canonical links and of ``meta`` refreshes in a page, as an array of strings."""
    empty = F.array().cast("array<string>")
    tags = F.coalesce(F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), 0), empty)
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?i)\srel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""))
    href = F.transform(canonical, lambda t: F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)""", 1))
    to = F.transform(refresh, lambda t: F.regexp_extract(t, r"""(?i)url\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.filter(F.concat(href, to), lambda x: x != "")


def folded(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` steps; one that would leave the root stays there."""
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), x))
    return F.aggregate(F.filter(F.split(path, "/"), lambda x, i: i > 0), F.lit(""), step)


def resolved(target: Column, url: Column) -> Column:
    """An absolute URL for a link target found at ``url``: ``&amp;`` is an ampersand, relative targets start at the page."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(url, r"^(.*?://[^/?#]*)", 1)
    path = path_of(url)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?", 1))
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    own, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)", 1)
    to = F.when(own == "", path).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    rest = F.when(target.startswith("#") | (target == ""), F.concat(query, target)).otherwise(rest)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^(.*?):", 1), F.lit(":"), target))
        .otherwise(F.concat(root, F.when(to == "", "").otherwise(folded(to)), rest))
    )


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as struct(size, allow, rule), else null; of equally long ones an allow wins."""
    tests = []
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        tests.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*tests))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """The verdict on every page: page_id, host, path, rule, verdict.

    A page that a rule fits has that rule's verdict. Any other page belongs to the component of its URL in the graph of
    redirects, canonical links and equal canonical forms: it is blocked if a rule blocks a member of the component and
    none allows one (an explicit allow has precedence), else allowed. A null URL, or one without ``://``, has an empty
    host and path and is allowed. Link targets are members too, whether or not they are rows of ``pages``; relative ones are
    resolved. Rows with repeated or null page_ids are judged each on its own. ``rules`` is a list of (verdict, rule) kept in the
    plan, so meant for up to some thousand rules. Nodes are 64-bit hashes of the forms.
    """
    url = F.col("url").cast("string")
    found = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(canonical_form(url)).alias("h"), canonical_form(url).isNotNull().alias("real"))
    found = found.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("hit"), F.when(F.col("real"), F.col("h")).alias("node"))
    links = pages.select(url.alias("url"), F.explode(link_targets(F.col("html").cast("string"))).alias("target"))
    links = links.select(canonical_form(F.col("url")).alias("a"), resolved(F.col("target"), F.col("url")).alias("to"))
    links = links.select("a", "to", canonical_form(F.col("to")).alias("b"))
    edges = links.where("a is not null and b is not null and a <> b").select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    comp = components(edges)
    linked = links.where("a is not null and b is not null").select(F.xxhash64("b").alias("node"), rule_for(host_of(F.col("to")), path_of(F.col("to")), rules).alias("hit"))
    ruled = found.select("node", "hit").union(linked).where("hit is not null and node is not null").groupBy("node").agg(F.max("hit.allow").alias("allow"), F.max(~F.col("hit.allow")).alias("block"))
    flags = ruled.join(comp, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    blocked = flags.where("block and not allow").select("root")
    members = comp.join(blocked, "root", "left_semi").select("node").union(blocked.select(F.col("root").alias("node"))).distinct()
    out = found.join(members.withColumn("by_alias", F.lit(True)), "node", "left")
    verdict = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.allow"), "allow").otherwise("block")).when(F.col("by_alias"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_FORM = r"""CASE WHEN {u} LIKE '%://%' THEN
  translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  || regexp_replace(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '/+$', '')
  || (CASE WHEN len(list_filter(string_split(regexp_extract({u}, '://[^?#]*\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|fbclid|gclid|ref)(?:=|$)'))) > 0
      THEN '?' || array_to_string(list_filter(string_split(regexp_extract({u}, '://[^?#]*\?([^#]*)', 1), '&'),
        lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|fbclid|gclid|ref)(?:=|$)')), '&') ELSE '' END) END"""

ORACLE = (
    r"""
WITH RECURSIVE rules(verdict, host, path, rule) AS (VALUES ('allow','com','/','com/'), ('block','example.com','/en/','example.com/en/'),
  ('allow','www.example.com','/en/','www.example.com/en/'), ('block','net','/es/','net/es/'), ('block','net','/fr/','net/fr/')),
p AS (SELECT row_number() OVER () AS i, page_id, html, url,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, """
    + _FORM.replace("{u}", "url")
    + r""" AS form FROM pages),
hit AS (SELECT p.i, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict
  FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.i),
raw AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM pages),
l AS (SELECT url, replace(CASE WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END, '&amp;', '&') AS t FROM raw),
parts AS (SELECT url, t, regexp_extract(url, '^(.*?://[^/?#]*)', 1) AS root, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) AS query, regexp_extract(t, '^[^?#]*') AS own, regexp_extract(t, '^[^?#]*(.*)', 1) AS rest FROM l WHERE t <> '' AND url LIKE '%://%'),
goes AS (SELECT *, CASE WHEN own = '' THEN path WHEN starts_with(own, '/') THEN own ELSE '/' || regexp_extract(path, '^/(.*/)?', 1) || own END AS dest FROM parts),
far AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t
  WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?):', 1) || ':' || t
  ELSE root || (CASE WHEN dest = '' THEN '' ELSE list_reduce(string_split(dest, '/'), lambda a, x:
    CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) END)
    || (CASE WHEN starts_with(t, '#') THEN query || t ELSE rest END) END AS t FROM goes),
e0 AS (SELECT """
    + _FORM.replace("{u}", "url")
    + " AS a, "
    + _FORM.replace("{u}", "t")
    + r""" AS b, translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(t, '://[^/?#]*([^?#]*)', 1) AS path FROM far WHERE t LIKE '%://%'),
aim AS (SELECT b AS form, arg_max(rules.verdict, length(rules.rule)) AS verdict
  FROM e0 JOIN rules ON (e0.host = rules.host OR ends_with(e0.host, '.' || rules.host)) AND starts_with(e0.path, rules.path) GROUP BY b, e0.host, e0.path),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
bad AS (SELECT form FROM p JOIN hit USING (i) WHERE verdict = 'block' UNION SELECT form FROM aim WHERE verdict = 'block'),
good AS (SELECT form FROM p JOIN hit USING (i) WHERE verdict = 'allow' UNION SELECT form FROM aim WHERE verdict = 'allow'),
rb AS (SELECT form FROM bad UNION SELECT e.b FROM rb JOIN e ON e.a = rb.form),
ra AS (SELECT form FROM good UNION SELECT e.b FROM ra JOIN e ON e.a = ra.form)
SELECT page_id, host, path, hit.rule AS rule, CASE WHEN hit.verdict IS NOT NULL THEN hit.verdict
  WHEN form IN (SELECT form FROM rb) AND form NOT IN (SELECT form FROM ra) THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN hit USING (i)
"""
)
