"""URL filters with redirect equivalence: rules decide, and block decisions reach the aliases of a blocked url.

Everything is DataFrame operations. Aliases are urls tied by canonical links or redirects; their connected components
are computed by star contractions over the edge table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depweave.llm.common import ascii_lower, stage
from depweave.llm.components import connected_components

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
Rule = tuple[str, str, str]
#: Rules up to this many are one array literal in the plan; more are joined by host suffix.
INLINE_RULES = 500


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _best(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits (ties: allow first, then by text), as struct<rule, verdict>, or null."""
    table = F.array(*[F.struct(F.lit(-len(h + p)).alias("length"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in sorted(rules)])
    return F.array_min(F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"])))


def with_rule(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """urls(url, ...) plus host, path, rule and own (the rule's verdict); both null where no rule fits.

    `rules` is a list, or a table (verdict, host, path) of any size, which is joined by host suffix.
    """
    parts = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if isinstance(rules, list) and len(rules) <= INLINE_RULES:
        best = _best(rules, F.col("host"), F.col("path")) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
        return parts.withColumn("__best", best).withColumn("rule", F.col("__best.rule")).withColumn("own", F.col("__best.verdict")).drop("__best")
    if isinstance(rules, list):
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    places = parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = places.select("host", "path", F.explode(suffixes).alias("__host")).join(rules.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "verdict"), "__host").filter(F.startswith("path", "__path"))
    rule = F.concat("__host", "__path")
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("length"), F.col("verdict"), rule.alias("rule"))).alias("__best"))
    return parts.join(best, ["host", "path"], "left").withColumn("rule", F.col("__best.rule")).withColumn("own", F.col("__best.verdict")).drop("__best")


#: Ports that a url of the scheme has anyhow.
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: References that urls in attributes are written with; others stay as they are.
REFERENCES = {"&quot;": '"', "&apos;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
#: Elements that begin the body where no tag says so.
_BODY = r"(?i)</head\b|<(?:body|div|p|h[1-6]|article|section|main|nav|aside|header|footer|table|ul|ol|dl|form|img|a|span|br|hr)\b"
_NOT_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title)\b.*?(?:</\1\b|\z)"
#: A link or meta tag of at most 60 quoted values, which may hold ">".
_TAG = r"""(?i)<(?:link|meta)\b(?:[^>"']*+(?:"[^"]*+"|'[^']*+')){0,60}+[^>"']*+>"""


def _site(url: Column) -> Column:
    """scheme://host of a url, lower-cased and without the scheme's own port."""
    site = ascii_lower(F.regexp_extract(url, r"(?s)^([^/?#]*://[^/?#]*)", 1))
    for scheme, port in DEFAULT_PORTS.items():
        site = F.regexp_replace(site, f"^({scheme}://[^:]*(?:\\[.*\\])?):(?:{port})?$", "$1")
    return site


def _without_dots(path: Column) -> Column:
    """A path whose "." and ".." segments are resolved; it begins with a slash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), step)
    slash = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), slash)


def node_of(url: Column) -> Column:
    """What the spellings of a url share: scheme and host lower-cased, no default port, no fragment, a resolved path of at least "/"."""
    path = F.regexp_extract(url, r"(?s)^[^/?#]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.concat(_site(url), _without_dots(F.when(path.startswith("/"), path).otherwise(F.lit("/"))), query)


def resolved(href: Column, url: Column) -> Column:
    """An href against its page: absolute, of the same scheme, site, page (an empty one or a query) or folder; null for other schemes."""
    scheme = F.regexp_extract(url, r"(?s)^([^/?#]*:)//", 1)
    site = F.regexp_extract(url, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^[^/?#]*://[^/?#]*((?:/[^?#]*)?/)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#") | (href == ""), query)
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag; '' without it."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    return F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)])


def _decoded(text: Column) -> Column:
    """Character references of ASCII characters replaced."""
    code = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.regexp_extract(m, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(m, "^&#([0-9]+)", 1)).cast("int")
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,5}|[xX][0-9a-fA-F]{1,4});"), 0))
    out = F.aggregate(numbers, text, lambda done, m: F.when(code(m).between(32, 126), F.replace(done, m, F.char(code(m)))).otherwise(done))
    for written, meant in REFERENCES.items():
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def link_edges(pages: DataFrame) -> DataFrame:
    """(u, v) between a page's url and its canonical link or refresh target, read from the page's head.

    The head ends where its end tag or the body begins; comments, scripts and the like in it are not read.
    """
    some = pages.filter("url is not null").filter(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    head = F.split(F.regexp_replace("html", _NOT_MARKUP, " "), _BODY, 2)[0]
    tag = some.select("url", F.explode(F.regexp_extract_all(head, F.lit(_TAG), 0)).alias("tag"))
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.trim(F.lower(_attribute(F.col("tag"), "rel"))), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.trim(F.lower(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    target = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*[\"']?([^\"']*)", 1)
    href = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, target)
    found = tag.withColumn("href", F.trim(_decoded(href))).filter("href <> ''").withColumn("to", resolved(F.col("href"), F.col("url"))).filter("to is not null")
    return found.select(node_of(F.col("url")).alias("u"), node_of(F.col("to")).alias("v"))


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, host, path, rule, verdict ('allow' or 'block').

    The longest fitting rule decides. A url without a rule is blocked if a url of its component (canonical links,
    refresh targets and the optional table redirects(source, target)) is blocked by a rule, else allowed; an explicit
    allow is never overruled. Spellings of one url (node_of) are one member of a component. Null urls and urls without '://' have empty host and path, no aliases and are allowed
    unless a rule says otherwise. Null html has no links. Repeated rows are judged one by one.
    """
    ruled = stage(with_rule(pages.select("page_id", "url"), rules), "url-rules")
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.filter("contains(source, '://') and contains(target, '://')").select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v")))
    members = connected_components(edges, "url-links")
    blocked = with_rule(members.withColumnRenamed("node", "url"), rules).filter("own = 'block'").select("root").distinct()
    reached = members.join(blocked, "root").select(F.col("node").alias("__node")).distinct().withColumn("__reached", F.lit(True))
    open_urls = ruled.filter("own is null").withColumn("__node", node_of(F.col("url"))).join(reached, "__node", "left")
    columns = ("page_id", "url", "host", "path", "rule")
    return ruled.filter("own is not null").select(*columns, F.col("own").alias("verdict")).unionByName(open_urls.select(*columns, F.when(F.col("__reached"), "block").otherwise("allow").alias("verdict")))
