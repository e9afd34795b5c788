"""Sitemaps, sitemap indexes and RSS, plain or gzipped, and breadth-first discovery over them."""

from __future__ import annotations

import gzip
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KIND = "array<struct<loc:string,lastmod:string,nested:boolean>>"


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower() if isinstance(e.tag, str) else ""


def parse_sitemap(content: bytes | None) -> list[dict]:
    """Pages and nested sitemaps, in order; broken XML gives none."""
    if not content:
        return []
    try:
        data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
        root = ET.fromstring(data)
    except (ET.ParseError, OSError, EOFError):
        return []
    out = []
    kinds = {"url": ("loc", "lastmod", False), "sitemap": ("loc", "lastmod", True), "item": ("link", "pubdate", False)}
    for e in root.iter():
        if (names := kinds.get(_local(e))) is not None:
            text = lambda name: next((c.text.strip() for c in e if _local(c) == name and c.text and c.text.strip()), None)  # noqa: B023, E731
            if loc := text(names[0]):
                out.append({"loc": loc, "lastmod": text(names[1]), "nested": names[2]})
    return out


def rss_url(c):
    """The sibling ``rss.xml`` of a sitemap's URL."""
    return F.concat(F.regexp_extract(c, "^(.*/)", 1), F.lit("rss.xml"))


def discover(files: DataFrame, roots: DataFrame, *, most_depth: int = 3) -> DataFrame:
    """(loc, lastmod, from_sitemap, depth): pages found from ``roots`` (url) through ``files`` (url, content), each location once.

    A round joins the frontier of sitemaps to their parsed rows; known ones are left out, so loops end."""
    parsed = files.select("url", F.explode(F.udf(parse_sitemap, _KIND)("content")).alias("x")).select("url", "x.*").checkpoint()
    frontier = seen = roots.select("url").distinct()
    pages = None
    for depth in range(most_depth + 1):
        rows = parsed.join(frontier, "url", "left_semi").withColumn("depth", F.lit(depth))
        found = rows.filter("NOT nested").select("loc", "lastmod", F.col("url").alias("from_sitemap"), "depth")
        pages = found if pages is None else pages.unionByName(found)
        frontier = rows.filter("nested").select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return pages.groupBy("loc").agg(F.min_by(F.struct("lastmod", "from_sitemap", "depth"), F.struct("depth", "from_sitemap")).alias("x")).select("loc", "x.*")
