"""Crawled pages: canonical URLs, duplicates, site tree, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.scalars import canonical_url, unfold
from tallymark.operators.quality import drift_diff

c = F.col


def page_canonicalize(pages: DataFrame) -> DataFrame:
    """Canonical URL, id derived from it, and a content hash."""
    url = canonical_url(c("url"))
    return pages.select("page_id", url.alias("canonical_url"), F.substring(F.sha2(url, 256), 1, 16).alias("node_id"),
                        F.sha2("html", 256).alias("content_hash"))


def page_dedupe(pages: DataFrame) -> DataFrame:
    """The first page per canonical URL and content, with how many copies went."""
    return (page_canonicalize(pages).groupBy("canonical_url", "content_hash")
            .agg(F.min("page_id").alias("page_id"), (F.count("*") - 1).alias("removed")))


def text_dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document per exact text; only digests are shuffled."""
    return (docs.groupBy(F.sha2(c(text), 256).alias("content_hash"))
            .agg(F.min(key).alias(key), (F.count("*") - 1).alias("removed")))


def page_tree(pages: DataFrame) -> DataFrame:
    """Nodes of the site trees: id, parent_id, depth, title, breadcrumb, page_type, site_id.

    Each page yields its path prefixes, which fold to one row per node. A node
    that is nobody's proper prefix is a leaf, so no second look at the table.
    """
    url = canonical_url(c("url"))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/]*)", 1)
    segments = F.filter(F.split(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/]*(.*)$", 1), "/"), lambda s: s != "")
    steps = (pages.select(host.alias("site_id"), segments.alias("seg"))
             .select("site_id", "seg", F.explode_outer(F.sequence(F.lit(0), F.size("seg"))).alias("depth")))
    here = F.concat(F.array("site_id"), F.slice("seg", 1, c("depth")))
    return (steps.select("site_id", "depth", here.alias("trail"), (c("depth") < F.size("seg")).alias("inner"))
            .groupBy("site_id", F.array_join("trail", "/").alias("id"), "depth", "trail").agg(F.max("inner").alias("inner"))
            .select("id", F.when(c("depth") > 0, F.array_join(F.slice("trail", 1, c("depth")), "/")).alias("parent_id"),
                    "depth", F.element_at("trail", -1).alias("title"), F.array_join("trail", " > ").alias("breadcrumb"),
                    F.when(c("depth") == 0, "index").when(c("inner"), "category").otherwise("leaf").alias("page_type"),
                    "site_id"))


def crawl_stats(pages: DataFrame) -> DataFrame:
    """Pages, leaves and removed duplicates per site."""
    host = F.regexp_extract("canonical_url", r"^[a-z][a-z0-9+.-]*://([^/]*)", 1)
    seen = (page_canonicalize(pages).groupBy(host.alias("site_id"), "canonical_url").agg(F.count("*").alias("n"))
            .groupBy("site_id").agg(F.sum("n").alias("pages_discovered"), F.sum(c("n") - 1).alias("duplicates_removed")))
    leaves = page_tree(pages).filter("page_type = 'leaf'").groupBy("site_id").agg(F.count("*").alias("leaves"))
    return seen.join(leaves, "site_id", "left").withColumn("leaves", F.coalesce("leaves", F.lit(0)))


def content_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages added, removed or with other content between two crawls."""
    return drift_diff(before.select("page_id", "html"), after.select("page_id", "html"), ["page_id"])


def link_edges(pages: DataFrame) -> DataFrame:
    """(page_id, source, target) for every link of every page."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return unfold(pages, ["page_id", canonical_url(c("url")).alias("source")], found, "target")
