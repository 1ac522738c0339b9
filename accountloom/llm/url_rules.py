"""URL rules with redirect equivalence, in built-in expressions only.

A url takes the verdict of the longest rule that fits it.  Urls without a rule take
the decision of their aliases: redirects (``meta refresh``) and canonical links are
edges between urls, and a component in which a rule blocks one url blocks every url
that no rule allows.  An explicit allow always stands.

Defined results: a null url, or one without ``://``, has an empty host and path, no
rule and no alias, and is allowed; null html has no links; repeated pages get one
result each; of several links or redirects of a page each one counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accountloom.llm.components import connected_components
from accountloom.session import pin

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'>]+)"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def matching_rule(rules: Sequence[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule whose host is the url's or above it; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _same_place(url: Column) -> Column:
    """What two spellings of one address share: no scheme, no fragment, a path."""
    path = path_of(url)
    return F.concat(host_of(url), F.when(path == "", "/").otherwise(path), _query_of(url))


def _absolute(href: Column, url: Column) -> Column:
    href = F.regexp_replace(F.trim(href), "&amp;", "&")
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    folder = F.regexp_replace(F.when(path_of(url) == "", "/").otherwise(path_of(url)), r"[^/]*$", "")
    site = F.concat(scheme, F.lit("://"), host_of(url))
    return (F.when(href == "", F.lit(None)).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(site, href))
            .when(href.startswith("#") | href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(href.startswith("?"), F.concat(site, path_of(url), href))
            .otherwise(F.concat(site, folder, href)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``u, v``: addresses that a redirect or a canonical link declares to be one."""
    url = F.col("url")
    tags = F.concat(*[F.regexp_extract_all("html", F.lit(p), F.lit(0)) for p in (LINK, REFRESH)])
    # an outer explode: an inner one would add a filter that reads every page a second time
    links = pages.select("url", F.explode_outer(tags).alias("tag")).filter(F.col("tag").isNotNull())
    href = F.concat(*[F.regexp_extract("tag", HREF, k) for k in (1, 2, 3)])
    address = F.when(F.col("tag").rlike(r"(?i)^<link\b"), href).otherwise(F.regexp_extract("tag", REFRESH_URL, 1))
    targets = links.select("url", _absolute(address, url).alias("target"))
    return (targets.filter(F.col("target").isNotNull() & (F.instr("url", "://") > 0))
            .select(_same_place(url).alias("u"), _same_place(F.col("target")).alias("v"))
            .filter("u <> v").distinct())


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every page."""
    groups = pin(connected_components(alias_edges(pages)), "aliases")
    address = F.concat(F.lit("x://"), F.col("node"))
    ruled = groups.select("component", matching_rule(rules, host_of(address), path_of(address))[1].alias("v"))
    blocked = (ruled.groupBy("component").agg(F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocked")))
    decided = groups.join(blocked, "component").select(F.col("node").alias("place"), "component", "blocked")
    rule, verdict = matching_rule(rules, F.col("host"), F.col("path"))
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                          _same_place(F.col("url")).alias("place"))
    judged = parsed.select("*", rule.alias("rule"), verdict.alias("own")).join(decided, "place", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("blocked"), "block").otherwise(default)).alias("verdict"), "component")
