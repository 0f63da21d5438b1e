"""URL filters over classes of equivalent urls, with DataFrame functions only.

A rule (host, path, action) fits a url whose host is the rule's or a subdomain of it and whose path starts with
the rule's path; the longest rule wins, then the longer host, then allow.  Urls that no rule fits take the
decision of their class: pages are linked to the targets of their redirects and canonical links, connected
components over those links are the classes, and a class with a blocked member is blocked unless another
member is explicitly allowed.  Classes without either are allowed.

Links are ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of the page (outside comments and scripts) and the
rows of an optional table (from_url, to_url), such as a log of redirects.  Spellings that servers redirect to one
another count as one node: scheme, ``www.``, fragment, ``utm_`` parameters and a closing slash are dropped.

Rules are matched by equality, not by scanning a list: for each combination of host labels and path length that
occurs among the rules, a url offers one (host suffix, path prefix) pair.

Results for odd input: a null url, or one without ``://``, has empty host and path, fits no rule, has no links and is
allowed; repeated rows are judged each; null html has no links; very long urls and pages are read whole; an empty
table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import join_counted, stored
from tidemark.llm.simhash import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COMMENTS = r"(?s)<!--.*?-->|(?i:<script\b).*?(?i:</script)"
LINK, META = r"(?i)<link\b[^>]*>", r"(?i)<meta\b[^>]*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TO_URL = r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def normal(url: Column) -> Column:
    """One spelling for urls that differ in scheme, www., fragment, tracking parameters or a closing slash; null without ``://``."""
    bare = F.regexp_replace(_rest(url), "(?s)#.*", "")
    asked = F.split(F.regexp_extract(bare, r"(?s)\?(.*)", 1), "&")
    kept = F.array_join(F.filter(asked, lambda p: (p != "") & ~p.startswith("utm_")), "&")
    place = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(F.instr(url, "://") > 0, F.concat(place, F.regexp_replace(path_of(url), "/$", ""), F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept))))


def resolved(url: Column, link: Column) -> Column:
    """``link`` as it stands on the page at ``url``, absolute; null if it cannot be."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, "^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), "(?s)^(.*/)", 1)
    return (F.when(link == "", None).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(F.instr(url, "://") == 0, None)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link))
            .when(link.rlike("^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
            .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def page_links(html: Column) -> Column:
    """Targets of canonical links and refreshes, as written."""
    read = F.when(html.rlike("(?i)canonical|http-equiv"), F.regexp_replace(html, COMMENTS, " ")).otherwise(F.lit(""))
    links = F.filter(F.regexp_extract_all(read, F.lit(LINK), F.lit(0)), lambda t: t.rlike(CANONICAL))
    metas = F.filter(F.regexp_extract_all(read, F.lit(META), F.lit(0)), lambda t: t.rlike(REFRESH))
    return F.concat(F.transform(links, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, TO_URL, 1)))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """row, rule, action: the winning rule of each row of ``urls`` (row, host, path) that any rule fits."""
    rules = stored(rules.select(F.translate("host", UPPER, LOWER).alias("rh"), F.col("path").alias("rp"), "action").distinct(), "rules")
    shapes = [tuple(r) for r in rules.select(F.size(F.split("rh", r"\.")), F.length("rp")).distinct().collect()]
    if not shapes:
        return urls.select("row", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action")).limit(0)
    offers = F.array_distinct(F.array(*[F.struct(F.substring_index("host", ".", -k).alias("rh"), F.left("path", F.lit(n)).alias("rp")) for k, n in sorted(shapes)]))
    offered = urls.select("row", F.explode(offers).alias("o")).select("row", "o.rh", "o.rp")
    fits = join_counted(offered, rules, ["rh", "rp"])
    rank = F.struct(F.length("rh") + F.length("rp"), F.length("rh"), (F.col("action") == "allow").cast("int"), "rh")
    return fits.groupBy("row").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "action"), rank).alias("w")).select("row", "w.rule", "w.action")


def url_verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, host, path, rule (or null), verdict, url_class (one value per class of equivalent urls; null without ``://``)."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    read = pages.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), url.alias("url"), page_links(html).alias("links"))
    read = read.withColumn("to", F.transform("links", lambda x: normal(resolved(F.col("url"), x))))
    read = stored(read.select("id", "row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.md5(normal(F.col("url"))).alias("node"), F.transform("to", lambda x: F.md5(x)).alias("to")), "urls")
    links = read.select(F.col("node").alias("a"), F.explode("to").alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(F.md5(normal(F.col("from_url"))).alias("a"), F.md5(normal(F.col("to_url"))).alias("b")))
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    roots = components(links).select(F.col("u").alias("node"), F.col("v").alias("url_class"))
    told = read.join(matched(read, rules), "row", "left")
    told = stored(told.drop("to"), "told")
    marks = told.where(F.col("action").isNotNull()).groupBy("node").agg(F.max("action").alias("most"), F.min("action").alias("least"))
    marks = marks.join(roots, "node", "left").groupBy(F.coalesce("url_class", "node").alias("url_class")).agg(F.max("most").alias("most"), F.min("least").alias("least"))
    judged = told.join(roots, "node", "left").withColumn("url_class", F.coalesce("url_class", "node")).join(marks, "url_class", "left")
    verdict = F.coalesce("action", F.when(F.col("least") == "allow", F.lit("allow")), F.when(F.col("most") == "block", F.lit("block")), F.lit("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "url_class")


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, action) as a table."""
    rows = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "action"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
