r"""URL filter with redirect equivalence, in DataFrame operations only.

Rules of host and path decide the URLs they fit, the longest rule first. Pages that redirect, or name
a canonical address, are aliases of each other: connected components over those links. A block
decision on any address of a component, crawled or not, reaches its pages without a rule of their own; an explicit allow of
a page stands against it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import written

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` in the expression once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _whole_path(path: Column) -> Column:
    """``path`` without its ``.`` and ``..`` segments."""
    none = F.array().cast("array<string>")
    step = lambda own, x: F.when(x == ".", own).when(x == "..", F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0)))).otherwise(F.concat(own, F.array(x)))
    last = lambda x: F.when(F.element_at(x, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none)
    rest = lambda x: F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(F.slice(x, F.lit(2), F.size(x)), none, step), last(x)), "/"))
    return _let(path, lambda p: F.when(p.rlike(r"/\.\.?(/|\z)"), _let(F.split(p, "/", -1), rest)).otherwise(p))


def _resolved(t: Column, base: Column) -> Column:
    place, path = F.regexp_extract(base, r"(?s)\A(.*?://[^/?#]*)", 1), path_of(base)
    folder = F.regexp_extract(F.concat(path, F.when(path == "", "/").otherwise("")), r"(?s)\A(.*/)", 1)
    scheme = F.regexp_extract(base, r"(?s)\A(.*?:)//", 1)
    return (
        F.when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*://"), t).when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(t.startswith("//"), F.concat(F.when(base.contains("://"), scheme).otherwise("http:"), t))
        .when(F.coalesce(place, F.lit("")) == "", None).when(t.startswith("/"), F.concat(place, t))
        .when(t.startswith("?"), F.concat(place, path, t)).when(t.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)\A[^#]*", 0), t))
        .otherwise(F.concat(place, folder, t))
    )


def resolve(target: Column, base: Column) -> Column:
    """The absolute address that ``target`` is for a page at ``base``; null without a host (``mailto:``, or nothing to resolve against)."""
    part = lambda full, group: F.regexp_extract(full, r"(?s)\A(.*?://[^/?#]*)[^?#]*(.*)", group)
    full = _let(target, lambda t: _let(base, lambda b: _resolved(t, b)))
    return _let(full, lambda x: F.when(x.contains("://"), F.concat(part(x, 1), _whole_path(path_of(x)), part(x, 2))))


def links(pages: DataFrame) -> DataFrame:
    """Alias links of pages (``page_id, url, html``) to absolute addresses: ``page_id, url, target``.

    Canonical link elements and refresh redirects; relative addresses are those of the page, or of its base element.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tags = F.concat(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)")), F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)")))
    decoded = lambda x: F.regexp_replace(x, r"(?i)&(amp|#0*38|#x0*26);", "&")
    base = decoded(F.regexp_extract(html, r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    tag = pages.select("page_id", "url", base.alias("base"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?canonical"), F.regexp_extract("tag", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.regexp_extract("tag", r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = tag.select("page_id", "url", "base", decoded(F.coalesce(canonical, refresh)).alias("target")).filter("target != ''")
    # Without a base element, the page's own url is the base.
    at = F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolve(F.col("base"), F.col("url")), "url"))
    return found.withColumn("base", at).select("page_id", "url", resolve(F.col("target"), F.col("base")).alias("target")).filter("target is not null")


def address(url: Column) -> Column:
    """What tells two addresses apart: host, path and query, without scheme and fragment."""
    query = lambda x: F.regexp_extract(x, r"(?s)\A.*?://[^/?#]*[^?#]*([^#]*)", 1)
    return _let(url, lambda x: F.regexp_replace(F.concat(host_of(x), _whole_path(path_of(x)), query(x)), "/$", ""))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Verdicts on pages (``page_id, url, html``) by rules (``host, path, verdict``).

    ``redirects`` (``source, target`` addresses) adds links to those in the pages. Returns ``page_id, host, path, rule,
    verdict, alias_of`` (the smallest address of the page's component, null without links), one row per input row. A rule fits its
    host and all subdomains if the path starts with its own; of several the longest text of
    host and path wins, then allow. Pages without rule are blocked if an alias is, be it a page or not, else allowed. A null
    url has an empty host and path; repeated pages each give a row; empty tables give empty results; other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.monotonically_increasing_id().alias("row"))
    parsed = pages.select("row", "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = links(pages).select(F.col("url").alias("source"), "target")
    if redirects is not None:
        found = found.unionByName(redirects.select("source", resolve(F.col("target"), F.col("source")).alias("target")))
    found = written(found.select("source", "target", address(F.col("source")).alias("a"), address(F.col("target")).alias("b")), "aliases").filter("a != '' and b != ''")
    # The addresses of links, whether pages have them or not, in the forms that links give them.
    named = found.select(F.explode(F.array(F.struct(F.col("a").alias("address"), F.col("source").alias("url")), F.struct(F.col("b").alias("address"), F.col("target").alias("url")))).alias("x"))
    named = named.select("x.address", host_of(F.col("x.url")).alias("host"), path_of(F.col("x.url")).alias("path")).distinct()

    # All ends of the host at its dots meet the rules' hosts.
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    given = rules.select(F.col("host").alias("end"), F.col("path").alias("prefix"), F.col("verdict").alias("decision"))
    places = parsed.select("host", "path").unionByName(named.select("host", "path")).distinct()
    fits = places.select("host", "path", F.explode(ends).alias("end")).join(given, "end").filter(F.col("path").startswith(F.col("prefix")))
    text = F.concat("end", "prefix")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("decision") == "allow").alias("allow"), text.alias("rule"), F.col("decision").alias("verdict"))).alias("best"))
    ruled = parsed.join(best, ["host", "path"], "left").select("row", "page_id", "url", "host", "path", "best.rule", F.col("best.verdict").alias("own"))

    groups = connected_components(found.select("a", "b")).withColumnsRenamed({"node": "address", "component": "alias_of"})
    placed = ruled.withColumn("address", address(F.col("url"))).join(groups, "address", "left")
    judged = named.join(best, ["host", "path"]).join(groups, "address").select(F.col("best.verdict").alias("own"), "alias_of")
    blocked = placed.select("own", "alias_of").unionByName(judged).filter("own = 'block' and alias_of is not null").select("alias_of").distinct().withColumn("spread", F.lit("block"))
    # Pages without links, most of them, have no component and are not dealt by one.
    alone = placed.filter("alias_of is null").withColumn("spread", F.lit(None).cast("string"))
    out = placed.filter("alias_of is not null").join(blocked, "alias_of", "left").unionByName(alone)
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "spread", F.lit("allow")).alias("verdict"), "alias_of")
