"""URL filters: rules by host and path, and block decisions that spread to aliases.

Two addresses are aliases if a redirect (``<meta http-equiv="refresh">`` or a given
table) or a canonical link leads from one to the other, directly or through others.
The aliases are the connected components of those edges.  A page that no rule decides
is blocked if any address among its aliases is blocked by a rule; a rule that fits the
page itself always comes first, so an explicit allow holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, col, durable
from .components import connected_components

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules are compared within the row; beyond so many they should be a table joined by host suffix.
MAX_RULES = 500

LINK = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b[^>]*>"
META = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'>\s]+)"
REFRESH = r"(?i)\burl\s*=\s*[\"']?([^\"'>\s;]+)"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)"))


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased), ``path`` and ``node`` (address without scheme and fragment; null without ``://``)."""
    d = df.withColumn("u", col(url_col))
    d = d.withColumn("rest", _after_scheme(F.col("u")))
    host = F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    tail = F.regexp_extract("rest", r"(?s)^[^/?#]*(.*)$", 1)
    d = d.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("tail", F.coalesce(tail, F.lit("")))
    d = d.withColumn("path", F.regexp_extract("tail", r"(?s)^([^?#]*)", 1))
    node = F.concat("host", F.regexp_extract("tail", r"(?s)^([^#]*)", 1))
    return d.withColumn("node", F.when(F.col("rest").isNotNull(), node)).drop("u", "rest", "tail")


def decide(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; equally long ones: allow first, then by text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _absolute(base: Column, target: Column) -> Column:
    scheme, origin = F.regexp_extract(base, r"^([^:]*):", 1), F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^([^:]*://[^/?#]*(?:/[^?#/]*)*/)[^/?#]*", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), target))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): absolute addresses of canonical links and refreshes found in the pages."""
    tags = pages.where(F.contains(col(url_col), F.lit("://"))).select(
        col(url_col).alias("src"),
        F.concat(
            F.transform(F.regexp_extract_all(col(html_col), F.lit(LINK), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
            F.transform(F.regexp_extract_all(col(html_col), F.lit(META), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH, 1)),
        ).alias("to"),
    )
    found = tags.select("src", F.explode("to").alias("to")).where("to <> ''")
    return found.select("src", _absolute(F.col("src"), F.replace("to", F.lit("&amp;"), F.lit("&"))).alias("dst")).distinct()


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: the id, host, path, rule, verdict (allow or block) and alias (the component's smallest address).

    Null addresses and those without ``://`` have an empty host and path, fit no rule, have no alias and
    are allowed.  Null html gives no edge.  ``edges`` (src, dst: absolute addresses) adds redirects known
    from elsewhere.  Repeated rows each give a row; an empty table gives none.
    """
    rules = RULES if rules is None else rules
    known = alias_edges(pages, url_col, html_col)
    if edges is not None:
        known = known.unionByName(edges.select(F.col("src"), F.col("dst")))
    ends = known.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = with_parts(ends, "a").select("b", F.col("node").alias("src"))
    ends = durable(with_parts(ends, "b").select("src", F.col("node").alias("dst")).where("src <> dst").distinct())

    d = with_parts(pages.select(col(id_col).alias("id"), col(url_col).alias("url")), "url")
    d = d.withColumn("r", decide(F.col("host"), F.col("path"), rules))
    if ends.isEmpty():  # no aliases at all: nothing can spread
        d = d.withColumn("component", F.lit(None).cast("string")).withColumn("spread", F.lit(False))
    else:
        parts = durable(connected_components(ends))
        split = parts.withColumn("h", F.regexp_extract("node", r"(?s)^([^/?#]*)", 1)).withColumn("p", F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1))
        blocked = split.withColumn("r", decide(F.col("h"), F.col("p"), rules)).where("r.verdict = 'block'").select("component").distinct()
        marked = parts.join(blocked.withColumn("spread", F.lit(True)), "component", "left").select(F.col("node").alias("n"), "component", "spread")
        d = d.join(durable(marked), F.col("node") == F.col("n"), "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("spread"), F.lit("block")), F.lit("allow"))
    return d.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.col("component").alias("alias"))


def digest(pages: DataFrame) -> DataFrame:
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    parts = lambda u: f"CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) END"
    host, tail = r"lower(regexp_extract({0}, '^[^/?#]*'))", r"regexp_extract({0}, '^[^/?#]*((?s:.*))$', 1)"

    def rule(h: str, p: str, what: str) -> str:
        cases = [f"WHEN ({h} = '{rh}' OR ends_with({h}, '.{rh}')) AND starts_with({p}, '{rp}') THEN '{v if what == 'verdict' else rh + rp}'" for v, rh, rp in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
        return f"CASE {' '.join(cases)} END"

    return rf"""
WITH RECURSIVE pg AS (
  SELECT page_id, url, html, {parts("url")} AS rest FROM pages),
d AS (
  SELECT *, coalesce({host.format("rest")}, '') AS host, coalesce(regexp_extract({tail.format("rest")}, '^[^?#]*'), '') AS path,
         {host.format("rest")} || regexp_extract({tail.format("rest")}, '^[^#]*') AS node
  FROM pg),
raw AS (
  SELECT node AS src, url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '{LINK.replace("'", "''")}'), lambda t: regexp_extract(t, '{HREF.replace("'", "''")}', 1)),
    list_transform(regexp_extract_all(html, '{META.replace("'", "''")}'), lambda t: regexp_extract(t, '{REFRESH.replace("'", "''")}', 1)))) AS t
  FROM d WHERE node IS NOT NULL),
abs AS (
  SELECT src, CASE
    WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x
    WHEN starts_with(x, '//') THEN regexp_extract(url, '^([^:]*):', 1) || ':' || x
    WHEN starts_with(x, '/') THEN regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || x
    ELSE coalesce(nullif(regexp_extract(url, '^([^:]*://[^/?#]*(?:/[^?#/]*)*/)[^/?#]*', 1), ''), regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || '/') || x END AS t
  FROM (SELECT src, url, replace(t, '&amp;', '&') AS x FROM raw WHERE t <> '')),
edge AS (
  SELECT src, {host.format("r")} || regexp_extract({tail.format("r")}, '^[^#]*') AS dst FROM (SELECT src, {parts("t")} AS r FROM abs) WHERE r IS NOT NULL),
sym AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge),
reach AS (
  SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
bad AS (
  SELECT DISTINCT a FROM (SELECT a, {host.format("b")} AS h, regexp_extract({tail.format("b")}, '^[^?#]*') AS p FROM reach)
  WHERE {rule("h", "p", "verdict")} = 'block')
SELECT page_id, host, path, {rule("host", "path", "rule")} AS rule,
       coalesce({rule("host", "path", "verdict")}, CASE WHEN bad.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM d LEFT JOIN bad ON d.node = bad.a
"""


ORACLE = _oracle()
