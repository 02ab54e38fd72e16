"""URL rules whose block decisions travel along redirects and canonical links.

A rule is (host, path, verdict); it fits its host and all subdomains where the url's path starts with the rule's, and
the longest rule wins. Urls without a fitting rule take the verdict of their component over redirect and canonical-link
edges: an explicit allow in it wins over any block, a block over nothing, and nothing means allow. So a page that a
rule allows stays allowed whatever its aliases are, and an alias of a blocked page cannot slip through.

Defined results. Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed unless linked.
Null or empty html has no links. Rows that repeat an id are judged each by its own url. Links to urls outside the table
carry decisions too: such urls are judged by the same rules. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lipika.llm.common import UPPER, stored, table, tidied
from lipika.llm.components import connected_components

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""


def parsed(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add host, path and node of a url column, in steps, so that no step repeats another's pattern.

    A node is the url without its fragment, scheme and host in lower case; null without ``://``.
    """
    at = F.locate("://", F.col(url))
    rest, raw, tail = f"_{prefix}rest", f"_{prefix}raw", f"_{prefix}tail"
    df = df.withColumn(rest, F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(""))
    df = df.withColumn(raw, F.regexp_extract(rest, r"^([^/?#]*)", 1))
    df = df.withColumn(tail, F.substring(F.col(rest), F.length(raw) + 1, F.length(rest)))
    df = df.withColumns({f"{prefix}host": F.translate(raw, UPPER, UPPER.lower()), f"{prefix}path": F.regexp_extract(tail, r"^([^?#]*)", 1)})
    scheme = F.lower(F.substring_index(url, "://", 1))
    full = F.concat(scheme, F.lit("://"), F.col(f"{prefix}host"), F.regexp_extract(tail, r"^([^#]*)", 1))
    return df.withColumn(f"{prefix}node", F.when(at > 0, full)).drop(rest, raw, tail)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule; null where none fits."""
    out = F
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = out.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
    return out


def _absolute(scheme: Column, host: Column, path: Column, link: Column) -> Column:
    """A link's target: absolute, scheme-relative, root-relative, or relative to the page's path; other schemes are not followed."""
    base = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    full = F.when(own == "", F.when(path == "", F.lit("/")).otherwise(path)).when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(base, _plain(full), F.substring(link, F.length(own) + 1, F.length(link))))
    )


def _plain(path: Column) -> Column:
    """A path from the root without its . and .. segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    start = F.array().cast("array<string>")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    # The first part is what is before the root's slash, so it stays out.
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    closing = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closing)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): canonical links and refresh redirects of the pages, as nodes. Only pages that mention one are parsed."""
    page = pages.select(pages[f"`{url}`"].alias("url"), pages[f"`{html}`"].alias("html"))
    page = page.filter(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv"))
    links = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in (CANONICAL, REFRESH)))
    # Of the entities only the ampersand's is usual in a link.
    found = page.select("url", F.explode(links).alias("link")).withColumn("link", F.regexp_replace("link", "(?i)&amp;", "&"))
    found = parsed(found, "url")
    found = found.withColumn("to", _absolute(F.substring_index("url", "://", 1), F.col("host"), F.col("path"), F.col("link")))
    return _edges(found.select("url", "to"))


def _edges(links: DataFrame) -> DataFrame:
    """(a, b) nodes of (url, to)."""
    both = parsed(parsed(links.select("url", "to"), "url"), "to", "to_")
    return both.select(F.col("node").alias("a"), F.col("to_node").alias("b")).filter("a <> b").distinct()


@tidied
def url_verdicts(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Per row: id, host, path, rule, verdict, component (null where the url has no link).

    ``redirects`` adds edges as a table of (from_url, to_url).
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(_edges(redirects.select(F.col("from_url").alias("url"), F.col("to_url").alias("to"))))
    edges = stored(edges, "url-edges")
    comp = stored(connected_components(edges, "a", "b"), "url-components")
    # Over a component's urls, whether in the table or only linked to: any explicit allow, else any block.
    nodes = parsed(comp.withColumnRenamed("node", "at"), "at").withColumn("r", rule(F.col("host"), F.col("path"), rules))
    said = nodes.groupBy("component").agg(F.min("r.verdict").alias("inherited"))
    comp = comp.join(said, "component").select(F.col("node").alias("at"), "component", "inherited")
    rows = parsed(pages.select(pages[f"`{id_col}`"].alias("_id"), F.coalesce(pages[f"`{url}`"], F.lit("")).alias("_url")), "_url")
    rows = rows.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    out = rows.join(comp, F.col("node") == F.col("at"), "left")
    verdict = F.coalesce("r.verdict", "inherited", F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "component")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages", "page_id", "url", "html")).drop("component")


def url_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with a table of redirects, which the given tables lack: pages in runs of five, each redirecting
    to the next one."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    to = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("to_url"))
    redirects = pages.filter("page_id % 5 < 4").join(to, "page_id").select(F.col("url").alias("from_url"), "to_url")
    return url_verdicts(pages, redirects=redirects).drop("component")


_HOST = "translate(regexp_extract({r}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END"


def _case(what: int) -> str:
    fits = " ".join(
        f"WHEN (host = '{r[0]}' OR host LIKE '%.{r[0]}') AND starts_with(path, '{r[1]}') THEN '{(r[0] + r[1], r[2])[what]}'"
        for r in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    return f"CASE {fits} END"


#: The tables of pages hold no redirect and no canonical link; where a url has one, this SQL follows none and the tests do.
SQL = f"""
WITH r AS (SELECT page_id, {_REST.format(u="coalesce(url, '')")} AS rest FROM pages),
p AS (SELECT page_id, {_HOST.format(r="rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {_case(0)} AS rule, coalesce({_case(1)}, 'allow') AS verdict FROM p
"""

#: Everything that redirects reach, in either direction, by plain recursion.
REDIRECT_SQL = f"""
WITH RECURSIVE r AS (SELECT page_id, url, {_REST.format(u="coalesce(url, '')")} AS rest FROM pages),
p AS (SELECT *, {_HOST.format(r="rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  CASE WHEN strpos(url, '://') > 0 THEN lower(split_part(url, '://', 1)) || '://' || {_HOST.format(r="rest")} || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS node FROM r),
v AS (SELECT *, {_case(0)} AS rule, {_case(1)} AS said FROM p),
e AS (SELECT a.node AS a, b.node AS b FROM v a JOIN v b ON b.page_id = a.page_id + 1 WHERE a.page_id % 5 < 4 AND a.node <> b.node),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
x(node, reach) AS (SELECT DISTINCT a, a FROM s UNION SELECT x.node, s.b FROM x JOIN s ON s.a = x.reach),
i AS (SELECT x.node, min(v.said) AS inherited FROM x JOIN v ON v.node = x.reach GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(said, inherited, 'allow') AS verdict FROM v LEFT JOIN i ON i.node = v.node
"""
