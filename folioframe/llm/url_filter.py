"""URL filters with redirect equivalence.

Explicit rules (host, path, verdict) come first: a rule fits its host and all subdomains if the url's path starts with
the rule's, and the longest fitting rule decides. A page that no rule fits takes its verdict from its aliases: pages
and urls joined by redirects (``<meta http-equiv=refresh>``) and canonical links form a graph whose connected
components are found in a distributed way; a component with a url that a rule blocks is blocked, unless a rule allows
one of its urls explicitly, and pages of no such component are allowed. Every such tag of a page counts. Ampersands written
as entities are read as such. Relative targets are resolved as in RFC 3986 against the page's ``<base href>``, or else its url. Urls meet by what they name:
case of scheme and host, default ports, fragments and dot segments make no difference. Tags in comments don't count.

Cases: a target of another kind (``mailto:``), or a relative one on a page whose url has no scheme and host, is no link; a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; repeated urls get
equal verdicts; a null html has no links; an html of any length is searched whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._runtime import ascii_lower, materialize, table

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_LINK = r'(?i)<link\b[^>]*\brel\s*=\s*["\']?canonical\b[^>]*>'
_HREF = r'(?i)\bhref\s*=\s*["\']?([^"\'\s>]+)'
_META = r'(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["\']?refresh\b[^>]*>'
_GOTO = r'(?i)\burl\s*=\s*["\']?([^"\'\s>;]+)'
_BASE = r'(?i)<base\b[^>]*\bhref\s*=\s*["\']?([^"\'\s>]+)'
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)//([^/?#]*)([^?#]*)((?:\?[^#]*)?)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or null."""
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fit = _fits(host, path, r)
        rule = F.when(fit, r[0] + r[1]) if rule is None else rule.when(fit, r[0] + r[1])
        verdict = F.when(fit, r[2]) if verdict is None else verdict.when(fit, r[2])
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _no_dots(path: Column) -> Column:
    """A path that begins with a slash, without the segments ``.`` and ``..``."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.greatest(F.size(F.split(path, "/", -1)) - 1, F.lit(1)))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x)))
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"))
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(whole, end)).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """``target`` as seen from the url ``base``, or null where that is no url with a host part."""
    scheme, host, path, query = (F.regexp_extract(base, _PARTS, i) for i in range(1, 5))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    root = F.concat(scheme, F.lit("//"), host)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    other = F.regexp_extract(own, r"(?s)^(//[^/]*)", 1)
    relative = (
        F.when(F.startswith(target, F.lit("//")), F.concat(scheme, other, _no_dots(F.substr(own, F.length(other) + 1)), rest))
        .when(F.startswith(target, F.lit("/")), F.concat(root, _no_dots(own), rest))
        .when(F.startswith(target, F.lit("?")), F.concat(root, path, target))
        .when((target == "") | F.startswith(target, F.lit("#")), F.concat(root, path, query, target))
        .otherwise(F.concat(root, _no_dots(F.concat(folder, own)), rest))
    )
    return F.when(target.rlike(_SCHEME), F.when(target.rlike(_SCHEME + "//"), target)).when(base.rlike(_PARTS), relative)


def identity(url: Column) -> Column:
    """What urls of one resource share: scheme and host lower-cased (A-Z), default port, fragment and dot segments gone, at least a
    slash as path; a url without scheme and host is itself."""
    scheme, host = ascii_lower(F.regexp_extract(url, _PARTS, 1)), ascii_lower(F.regexp_extract(url, _PARTS, 2))
    path, query = F.regexp_extract(url, _PARTS, 3), F.regexp_extract(url, _PARTS, 4)
    port = F.when(scheme == "http:", F.regexp_replace(host, r":(?:80)?$", "")).when(scheme == "https:", F.regexp_replace(host, r":(?:443)?$", "")).otherwise(host)
    whole = F.concat(scheme, F.lit("//"), port, F.when(path == "", "/").otherwise(_no_dots(path)), query)
    return F.when(url.rlike(_PARTS), whole).otherwise(url)


def links(pages: DataFrame) -> DataFrame:
    """Rows (url, target) of all redirect and canonical targets outside of comments, resolved; both as ``identity``."""

    def targets(tag: str, part: str) -> Column:
        return F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, part, 1))

    may = F.lower(F.col("html"))
    found = pages.where(F.col("url").isNotNull()).where(F.contains(may, F.lit("canonical")) | F.contains(may, F.lit("refresh")))
    found = found.select("url", F.regexp_replace("html", _COMMENT, "").alias("html"))
    plain = lambda c: F.replace(F.replace(c, F.lit("&#38;"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    found = found.select("url", plain(F.regexp_extract("html", _BASE, 1)).alias("base"), F.explode(F.transform(F.concat(targets(_LINK, _HREF), targets(_META, _GOTO)), plain)).alias("target")).where("target <> ''")
    base = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolve(F.col("url"), F.col("base")), "url"))
    # Each step is a row that is generated, so that the next one refers to it and doesn't repeat how it was made.
    found = found.select("url", "target", F.inline(F.array(F.struct(base.alias("base")))))
    found = found.select("url", F.inline(F.array(F.struct(resolve(F.col("base"), F.col("target")).alias("target"))))).where(F.col("target").isNotNull())
    return found.select(F.inline(F.array(F.struct(identity(F.col("url")).alias("url"), identity(F.col("target")).alias("target")))))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, url, host, path, rule, verdict."""
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": rule, "verdict": verdict})
    edges = materialize(links(pages).distinct(), "links")
    if edges.isEmpty():
        return own.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    member = materialize(components(edges, "url", "target"), "components")
    said = member.withColumn("v", decide(host_of(F.col("node")), path_of(F.col("node")), rules)[1])
    of = said.groupBy("component").agg(F.max(F.when(F.col("v") == "block", 1).otherwise(0)).alias("bad"), F.max(F.when(F.col("v") == "allow", 1).otherwise(0)).alias("good"))
    alias = member.join(of.where("bad = 1 and good = 0").select("component"), "component").select(F.col("node").alias("_id"), F.lit("block").alias("alias"))
    return own.select("*", F.inline(F.array(F.struct(identity(F.col("url")).alias("_id"))))).join(alias, "_id", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _id_sql(url: str) -> str:
    """As ``identity``, but for dot segments."""
    host = f"lower(regexp_extract({url}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
    host = f"regexp_replace(regexp_replace({host}, '^(http://.*?):(80)?$', '\\1'), '^(https://.*?):(443)?$', '\\1')"
    path = f"regexp_extract({url}, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({url}, '(?s)^[^?#]*((?:[?][^#]*)?)', 1)"
    return f"CASE WHEN regexp_matches({url}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {query} ELSE {url} END"


#: Relative targets and dot segments are left out here.
ORACLE = r"""
WITH RECURSIVE u AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rh, rp, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), shown AS (
  SELECT url, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS html FROM pages WHERE url IS NOT NULL
), link AS (
  SELECT DISTINCT id(url) AS a, id(t) AS b FROM (
    SELECT url, replace(replace(unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))), '&#38;', '&'), '&amp;', '&') AS t
    FROM shown) WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://')
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), node AS (
  SELECT DISTINCT a AS url FROM both_ways
), node_parts AS (
  SELECT url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM node
), node_verdict AS (
  SELECT url, arg_max(v, length(rh || rp)) AS v FROM node_parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url
), alias AS (
  SELECT r.a AS url FROM reach r JOIN node_verdict n ON n.url = r.b GROUP BY r.a HAVING bool_or(n.v = 'block') AND NOT bool_or(n.v = 'allow')
), best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path
)
SELECT u.page_id, u.url, u.host, u.path, best.rule, coalesce(best.v, CASE WHEN id(u.url) IN (SELECT url FROM alias) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (host, path)
""".replace("id(url)", _id_sql("url")).replace("id(t)", _id_sql("t")).replace("id(u.url)", _id_sql("u.url"))
