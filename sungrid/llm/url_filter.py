"""URL rules whose decisions reach the aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import ascii_lower, table
from .components import components

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# One of the words of ``rel``, which may have quotes.
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*(?:\"(?:[^\">]*\s)?canonical(?:\s[^\">]*)?\"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical\b)[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_GOES = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.position(F.lit("://"), url)
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where the url is null or has no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule fits its
    host and all subdomains, if the path starts with the rule's. Of rules of one
    length the first in alphabetical order counts."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_DOTS = r"(^|/)\.\.?(/|$)"


def plain_path(path: Column) -> Column:
    """A path without the segments ``.`` and ``..``, which lead a step back; an empty path is ``/``."""
    parts = F.split(path, "/", -1)
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), lambda at, s: F.when(s == ".", at).when(s == "..", F.regexp_replace(at, "/[^/]*$", "")).otherwise(F.concat(at, F.lit("/"), s)))
    short = F.concat(walked, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path == "", "/").when(path.rlike(_DOTS), short).otherwise(path)


def node_of(url: Column) -> Column:
    """What a request for a url names: without fragment, scheme and host in lower
    case, the path without dot segments and never empty (RFC 3986, 6.2)."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    scheme = F.regexp_extract(bare, r"^([^/?]*?)://", 1)
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    return F.when(F.position(F.lit("://"), bare) > 0, F.concat(ascii_lower(scheme), F.lit("://"), host_of(bare), plain_path(path_of(bare)), query)).otherwise(bare)


def resolve(href: Column, url: Column) -> Column:
    """An absolute url for a reference on the page at ``url``; null where it leads nowhere else."""
    href = F.trim(F.replace(href, F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract(url, r"^([^/?#]*?)://", 1)
    site = F.regexp_extract(url, r"^[^/?#]*?://[^/?#]*", 0)
    page = F.regexp_extract(url, r"^[^?#]*", 0)
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path_of(url), r"^(.*/)", 1), F.lit("")), F.lit("/")))
    based = F.position(F.lit("://"), url) > 0
    return (F.when(href.isNull() | (href == "") | href.startswith("#"), None).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(~based, None)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?"), F.concat(page, href))
            .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(F.concat(folder, href)))


def page_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): from a page to its canonical link and to where its meta refresh
    goes; the first of each kind counts. Null urls and html have no edges."""
    src = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).where(F.col("u").isNotNull() & F.col("h").rlike("(?i)canonical|http-equiv"))
    canonical = F.regexp_extract(F.regexp_extract("h", _LINK, 0), _HREF, 1)
    refresh = F.regexp_extract(F.regexp_extract("h", _META, 0), _GOES, 1)
    goes = src.select("u", F.explode(F.array(resolve(canonical, F.col("u")), resolve(refresh, F.col("u")))).alias("to")).where("to is not null")
    return goes.select(node_of(F.col("u")).alias("a"), node_of(F.col("to")).alias("b"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, *, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict.

    A page that a rule fits has that rule's verdict. Any other takes the decision
    of its aliases: urls that canonical links, meta refreshes and the (src, dst)
    rows of ``redirects`` connect, at any number of steps, in the table or not.
    Where a rule allows one of them, it is allowed; else where a rule blocks one,
    it is blocked; else it is allowed.

    Urls that name the same request are one: their fragment, the case of scheme
    and host, dot segments and an empty path make no difference here; host, path
    and rule are those of the url as written.

    Null urls and such without ``://`` have no host, path or rule. Repeated rows
    are judged each. No rows give none; other columns are not read. Html of any
    length is searched where it is read, by patterns that do not back up far.
    """
    edges = page_edges(pages, url=url, html=html)
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("src")), node_of(F.col("dst"))))
    found = cut_lineage(components(edges, "a", "b"))
    every = found.select("node", "root").union(found.select("root", "root").distinct())
    verdict = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"]
    decided = every.select("node", "root", verdict.alias("v")).where("v is not null").groupBy("root").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"))
    decided = decided.select("root", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("of_alias"))
    alias = cut_lineage(every.join(decided, "root").select("node", "of_alias"))

    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("u"))
    src = src.select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), node_of(F.col("u")).alias("n"))
    src = src.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    out = src.join(alias, F.col("n") == F.col("node"), "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "of_alias", F.lit("allow")).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same for DuckDB, components by reachability."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = lambda u: f"CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) END"
    host = lambda u: f"coalesce(translate(regexp_extract({rest(u)}, '^[^/?#]*', 0), '{upper}', '{upper.lower()}'), '')"
    path = lambda u: f"coalesce(regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1), '')"
    bare = lambda u: f"regexp_extract({u}, '^[^#]*', 0)"
    walk = "CASE WHEN s = '.' THEN walked WHEN s = '..' THEN regexp_replace(walked, '/[^/]*$', '') ELSE walked || '/' || s END"
    plain = lambda p: (f"CASE WHEN {p} = '' THEN '/' WHEN regexp_matches({p}, '{_DOTS}') THEN list_reduce(list_concat([''], split({p}, '/')[2:]), lambda walked, s: {walk}) "  # noqa: E731
                       f"|| CASE WHEN split({p}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END ELSE {p} END")
    node = lambda u: (f"CASE WHEN strpos({bare(u)}, '://') > 0 THEN translate(regexp_extract({bare(u)}, '^([^/?]*?)://', 1), '{upper}', '{upper.lower()}') || '://' || {host(bare(u))} "  # noqa: E731
                      f"|| {plain(path(bare(u)))} || regexp_extract({bare(u)}, '(\\?.*)$', 1) ELSE {bare(u)} END")
    rule = lambda h, p, i: "CASE " + " ".join(f"WHEN ({h} = '{r[1]}' OR {h} LIKE '%.{r[1]}') AND starts_with({p}, '{r[2]}') THEN '{r[1] + r[2] if i else r[0]}'"
                                               for r in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    href, site = "trim(replace(h, '&amp;', '&'))", "regexp_extract(u, '^[^/?#]*?://[^/?#]*', 0)"
    to = (f"CASE WHEN h IS NULL OR {href} = '' OR starts_with({href}, '#') THEN NULL WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {href} WHEN strpos(u, '://') = 0 THEN NULL "
          f"WHEN starts_with({href}, '//') THEN regexp_extract(u, '^([^/?#]*?)://', 1) || ':' || {href} WHEN starts_with({href}, '/') THEN {site} || {href} "
          f"WHEN starts_with({href}, '?') THEN regexp_extract(u, '^[^?#]*', 0) || {href} WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL "
          f"ELSE {site} || coalesce(nullif(regexp_extract({path('u')}, '^(.*/)', 1), ''), '/') || {href} END")
    quote = lambda s: s.replace("'", "''")
    return f"""
WITH RECURSIVE refs AS (
  SELECT url AS u, unnest([regexp_extract(regexp_extract(html, '{quote(_LINK)}', 0), '{quote(_HREF)}', 1), regexp_extract(regexp_extract(html, '{quote(_META)}', 0), '{quote(_GOES)}', 1)]) AS h
  FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
goes AS (SELECT u, {to} AS t FROM refs),
one AS (SELECT {node('u')} AS a, {node('t')} AS b FROM goes WHERE t IS NOT NULL),
edge AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
reach AS (SELECT a, a AS b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
alias AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS of_alias
          FROM (SELECT a, {rule(host('b'), path('b'), 0)} AS v FROM reach) WHERE v IS NOT NULL GROUP BY a),
page AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {node('url')} AS n FROM pages)
SELECT page_id, host, path, {rule('host', 'path', 1)} AS rule, coalesce({rule('host', 'path', 0)}, of_alias, 'allow') AS verdict
FROM page LEFT JOIN alias ON n = a
"""


SQL = _sql()
