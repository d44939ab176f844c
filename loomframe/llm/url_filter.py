"""URL rules with redirect equivalence, by DataFrame operations only.

A rule is (host, path, verdict): it fits its host and all subdomains if the URL's path starts with the rule's.
The longest fitting rule decides.  URLs that redirect to each other or name each other as canonical are one
class, found by distributed connected components; a URL without a rule takes its class's verdict: allowed if a
member is explicitly allowed, else blocked if a member is explicitly blocked, else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: As many rules as this compile into one expression; more are joined on the hosts that they fit.
COMPILED = 200
# Character references that occur in addresses.
REFERENCES = (("&#38;", "&"), ("&#x26;", "&"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&sol;", "/"), ("&#58;", ":"), ("&colon;", ":"), ("&#61;", "="), ("&equals;", "="), ("&quest;", "?"), ("&num;", "#"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
CONTRACT_RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    """What names a URL in the graph: without fragment, scheme and host lower-cased; null if it has no ``://``."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), url_host(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _resolved(page: Column, ref: Column) -> Column:
    """``ref`` as read on ``page``, by RFC 3986; null for another kind of scheme and for a mere fragment."""
    base, path = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1), url_path(page)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    full = F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), ref).when(ref.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|#)"), F.lit(None))
    full = full.when(ref.startswith("//"), F.concat(F.regexp_extract(page, r"(?s)^(.*?:)//", 1), ref)).when(ref.startswith("/"), F.concat(base, ref))
    full = full.when(ref.startswith("?"), F.concat(base, path, ref)).otherwise(F.concat(base, F.regexp_extract(path, r"(?s)^(.*/)", 1), ref))
    parts = F.split(url_path(full), "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    front, rest = F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(full, r"(?s)^.*?://[^/?#]*[^?#]*(.*)", 1)
    return F.when(url_path(full).rlike(r"/\.\.?(/|$)"), F.concat(front, clean, rest)).otherwise(full)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst)`` of the canonical links and refreshes, at any delay, that pages declare.  Relative targets are resolved against the page's URL."""
    tag = r"(?is)<(?:link|meta)\b[^>]*>"
    some = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where(F.col("u").contains("://") & F.col("h").rlike(r"(?i)canonical|http-equiv"))
    some = some.select("u", F.explode(F.regexp_extract_all(F.regexp_replace("h", r"(?s)<!--.*?-->|(?i:<script\b.*?</script>)", ""), F.lit(tag), F.lit(0))).alias("t"))
    # few rows; stored, so that each step's expressions are computed once
    tags = materialize(some.where(F.col("t").rlike(r"""(?is)\brel\s*=[^>]*\bcanonical\b|\bhttp-equiv\s*=\s*["']?refresh""")), "url-tags")
    canonical = F.regexp_extract("t", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("t", r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*['"]?([^'"\s>]+)""", 1)
    named = F.when(F.lower("t").startswith("<link"), canonical).otherwise(refresh)
    for ref, sign in REFERENCES:
        named = F.replace(named, F.lit(ref), F.lit(sign))
    target = tags.select("u", named.alias("d"))
    target = materialize(target.where("d != ''"), "url-targets")
    out = materialize(target.select(F.col("u").alias("src"), _resolved(F.col("u"), F.col("d")).alias("dst")), "url-links")
    release(tags, target)
    return out.where("dst IS NOT NULL")


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; of equally long ones an allowing rule."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[2] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]], *keep: str) -> DataFrame:
    """``urls(host, path, ...)``, of it the columns ``keep``, with ``rule`` and ``own``, the fitting rule and its verdict."""
    if len(rules) <= COMPILED:
        name, verdict = _rule(F.col("host"), F.col("path"), rules)
        return urls.select(*keep, name.alias("rule"), verdict.alias("own"))
    table = urls.sparkSession.createDataFrame([(h, p, v) for h, p, v in rules], "rh string, rp string, v string")
    table = table.groupBy("rh").agg(F.collect_set(F.struct("rp", "v")).alias("rs"))  # as long as the rules for a host
    parts = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.filter("rs", lambda r: F.col("path").startswith(r["rp"]))
    fits = F.transform(fits, lambda r: F.struct((F.length("rh") + F.length(r["rp"])).alias("n"), (r["v"] == "allow").alias("a"), F.concat("rh", r["rp"]).alias("rule"), r["v"].alias("v")))
    asked = urls.select("host", "path").distinct()
    said = asked.select("host", "path", F.explode(tails).alias("rh")).join(table, "rh").select("host", "path", F.array_max(fits).alias("r"))
    said = said.groupBy("host", "path").agg(F.max("r").alias("r")).where("r IS NOT NULL")
    said = materialize(said.select("host", "path", F.col("r.rule").alias("rule"), F.col("r.v").alias("own")), "url-ruled")
    return urls.join(said, ["host", "path"], "left").select(*keep, "rule", "own")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    ``redirects`` holds further edges ``(src, dst)``; canonical links and refreshes are read from ``html_col`` if
    it is given.  A URL that is null or has no ``://`` has an empty host and path, fits no rule and is allowed;
    null html declares no link; repeated rows and null ids get the results of their URLs; URLs and html of any length
    are read whole; an empty table gives no row; other columns play no part.
    """
    seen = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), _node(F.col(url_col)).alias("node"))
    seen = _ruled(seen, rules, "id", "host", "path", "node")
    edges = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        more = redirects.select("src", "dst")
        edges = more if edges is None else edges.unionAll(more)
    classed = None
    if edges is not None:
        edges = materialize(edges.select(_node(F.col("src")).alias("a"), _node(F.col("dst")).alias("b")).where("a != b").distinct(), "url-edges")
        if not edges.isEmpty():
            # the target of a link need not be a page; its rule counts all the same
            comp = materialize(connected_components(edges), "url-comp")
            ruled = _ruled(comp.select("component", url_host(F.col("node")).alias("host"), url_path(F.col("node")).alias("path")), rules, "component")
            said = ruled.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allow"), F.max(F.col("own") == "block").alias("block"))
            said = said.select("component", F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block")).otherwise(F.lit("allow")).alias("class_verdict"))
            classed = materialize(comp.join(said, "component").select("node", "class_verdict").where("class_verdict = 'block'"), "url-blocked")
            release(comp)
        release(edges)
    if classed is None:
        seen = seen.withColumn("class_verdict", F.lit(None).cast("string"))
    else:
        seen = seen.join(classed, "node", "left")
    return seen.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("own", "class_verdict", F.lit("allow")).alias("verdict"))


def op3_url_filter(spark, sf_dir):
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), CONTRACT_RULES)


_HOST = "coalesce(translate(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
OP3_SQL = f"""
WITH p AS (SELECT page_id, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
        FROM (SELECT DISTINCT p.*, rh, rp, v FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) GROUP BY 1, 2, 3)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.v, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.page_id IS NOT DISTINCT FROM fit.page_id AND p.host = fit.host AND p.path = fit.path
"""
