"""What browser snapshots of a host's pages say: links to follow, flags over pages, the token that stands for all, asset domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import hosts as H
from cairnfield.functions import http as W
from cairnfield.functions import text as T

#: Names of features that a token is preferred for.
FEATURE = r"(?i)webmcp|modelcontext"
ASSET_DOMAINS = 25


def candidates(html: Column) -> Column:
    """Links of a page in document order: href, and whether it stands in a menu (a `nav` or `header` element)."""
    parts = F.regexp_extract_all(html, F.lit(r"(?is)<(nav|header)\b.*?</\1\s*>|((?!<(?:nav|header)\b).)+"), F.lit(0))
    href = F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']+)[\"']")
    inside = lambda p: p.rlike(r"(?i)^<(nav|header)\b")
    return F.flatten(F.transform(parts, lambda p: F.transform(F.regexp_extract_all(p, href, F.lit(1)), lambda u: F.struct(u.alias("href"), inside(p).alias("nav")))))


def pick_links(pages: DataFrame, most: int, *, key: str = "page_id", url: str = "url", links: str = "links") -> DataFrame:
    """key, n, link: up to `most` links of each page to pages of its own registrable domain, menu links first, then in document order.

    A link's fragment doesn't count; files, ways out of a session and the page itself are passed over. A page's links stand in one row.
    """
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(links).alias("_pos", "_l"))
    # links that can't be resolved leave an empty array
    rows = rows.withColumn("link", F.get(W.resolve_links(F.array(F.col("_l.href")), F.col("_base")), F.lit(0)))
    rows = rows.withColumn("link", F.regexp_replace("link", "#.*$", ""))
    own = F.regexp_replace(F.get(W.resolve_links(F.array(F.col("_base")), F.col("_base")), F.lit(0)), "#.*$", "")
    path = T.path(F.col("link"))
    same = H.registrable(T.hostname(F.col("link"))) == H.registrable(T.hostname(F.col("_base")))
    good = rows.filter(F.col("link").rlike("(?i)^https?://") & same & ~W.is_asset(path) & ~W.is_leaving(path) & (F.col("link") != own))
    first = good.groupBy(key, "link").agg(F.min(F.struct("_pos", F.col("_l.nav").alias("nav"))).alias("f"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((~F.col("f.nav")).alias("rest"), F.col("f._pos").alias("pos"), "link"))).alias("all"))
    return listed.select(key, F.posexplode(F.slice("all", 1, most)).alias("n", "x")).select(key, (F.col("n") + 1).alias("n"), "x.link")


def flags(pages: DataFrame, names: list[str], *, host: str = "host", pos: str = "pos") -> DataFrame:
    """Any-reduction of flags over the pages of a host, and how many pages it has."""
    return pages.groupBy(host).agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in names], F.count(pos).alias("pages"))


def preferred_token(tokens: DataFrame, *, host: str = "host", pos: str = "pos") -> DataFrame:
    """host, feature, expiry, tokens: of the first token with the wanted feature, else the first with any, else the first."""
    rank = F.when(F.col("feature").rlike(FEATURE), 0).when(F.coalesce("feature", F.lit("")) != "", 1).otherwise(2)
    return tokens.groupBy(host).agg(F.min_by(F.struct("feature", "expiry"), F.struct(rank, pos)).alias("t"), F.count("*").alias("tokens")).select(host, "t.feature", "t.expiry", "tokens")


def asset_domains(pages: DataFrame, *, key: str = "host", host: str = "host", html: str = "html", most: int = ASSET_DOMAINS) -> DataFrame:
    """key, nth, domain, n: the registrable domains that a page's scripts, links, images and frames come from, its own left out, the most frequent first (ties by first appearance)."""
    own = F.coalesce(H.registrable(F.col(host)), F.col(host))
    rows = pages.select(F.col(key).alias("_key"), own.alias("_own"), F.posexplode(W.asset_hosts(F.col(html))).alias("_pos", "_h"))
    rows = rows.withColumn("domain", F.coalesce(H.registrable(F.col("_h")), "_h")).filter("domain <> _own")
    counted = rows.groupBy("_key", "domain").agg(F.count("*").alias("n"), F.min("_pos").alias("_first"))
    listed = counted.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "_first", "domain"))).alias("all"))
    return listed.select(F.col("_key").alias(key), F.posexplode(F.slice("all", 1, most)).alias("k", "x")).select(key, (F.col("k") + 1).alias("nth"), "x.domain", (-F.col("x.neg")).alias("n"))
