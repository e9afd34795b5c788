"""The web corpus from start to end: discovered URLs and a page snapshot become documents, chunks, questions, rejects and a summary.

Fetching lies outside the engine: ``snapshot`` (url, html, status, content_type, error) is what a crawler left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import content_hash, path_slug
from ..operators import audit, chunking, classify, pages, urls


@dataclass
class WebCorpus:
    documents: DataFrame
    chunks: DataFrame
    faqs: DataFrame
    rejected: DataFrame

    def summary(self) -> DataFrame:
        """(counter, value, n): documents by audience, topic and source, and rejects by reason."""
        return audit.counters(self.documents, ["audience", "topic", "source"]).unionByName(audit.counters(self.rejected, ["reason"]))


def fetch_error(status: str = "status", content_type: str = "content_type", error: str = "error") -> Column:
    """Why a fetched page can't be used, or null: its own error, then a status of 400 or more, then a type other than HTML."""
    kind = F.lower(F.coalesce(F.col(content_type), F.lit("text/html")))
    return F.when(F.coalesce(F.col(error), F.lit("")) != "", "download_error").when(F.col(status) >= 400, "download_error").when(kind.contains("pdf"), "pdf").when(~kind.contains("html"), "non_html")


def discovered(config: Config, found: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """``found`` (source, url, lastmod, seq) and, by hand, URLs that are not among them, with their decisions."""
    if manual is not None:
        known = found.select(F.col("source").alias("_s"), urls.canonical_url("url").alias("_u"))
        fresh = manual.join(known, (F.col("source") == F.col("_s")) & (urls.canonical_url("url") == F.col("_u")), "left_anti")
        found = found.unionByName(fresh, allowMissingColumns=True)
    return urls.decide(found, list(config.sources), source="source", global_exclude=config.global_exclude)


def build(config: Config, decided: DataFrame, snapshot: DataFrame, *, max_pages: int | None = None) -> WebCorpus:
    """Documents of accepted URLs. ``decided`` has source, url, lastmod, seq and decision; seq says who comes first."""
    d = config.defaults
    excluded = decided.filter("NOT decision.accepted").select(F.col("decision.url").alias("url"), F.col("decision.reason").alias("reason"), "source")
    accepted = decided.filter("decision.accepted").select("source", F.col("decision.url").alias("url"), "lastmod", "seq")
    if max_pages is not None:  # a limit per source, counted before any dedup
        accepted = audit.capped(accepted, by="source", order="seq", most=max_pages)
    kept = snapshot.select(urls.canonical_url("url").alias("_u"), "html", fetch_error().alias("_why"))
    # of several snapshots of a URL one without an error comes first, then the one of least hash: whole rows, alike in every run
    order = F.struct(F.col("_why").isNotNull(), F.col("html").isNull(), F.xxhash64("html"), F.col("_why"))
    kept = kept.groupBy("_u").agg(F.min_by(F.struct("html", "_why"), order).alias("_page")).select("_u", "_page.html", "_page._why")
    joined = accepted.join(kept, F.col("url") == F.col("_u"), "left").withColumn("reason", F.when(F.col("_u").isNull() | F.col("html").isNull() & F.col("_why").isNull(), "download_error").otherwise(F.col("_why")))
    # a URL counts as seen as soon as it has a page, even if that page is rejected later
    nth = F.row_number().over(Window.partitionBy("url", F.col("reason").isNull()).orderBy("seq"))
    joined = joined.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate").otherwise(F.col("reason"))).drop("_u", "_why")
    read = pages.read_pages(joined.filter("reason IS NULL")).withColumn("reason", pages.rejection(least_chars=d.min_chars, most_links=d.max_link_ratio))
    good = read.filter("reason IS NULL")
    base = good.withColumn("_base", path_slug(F.col("source"), urls.url_part("url", 3)))
    use = F.row_number().over(Window.partitionBy("_base").orderBy("seq"))
    base = base.withColumn("id", F.when(use == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.substring(F.sha1("url"), 1, 6))))
    same = F.row_number().over(Window.partitionBy("_hash").orderBy("seq"))
    base = base.withColumn("_hash", content_hash("page.text")).withColumn("_copy", same > 1)
    # per source: its own defaults
    audiences = F.coalesce(*(F.when(F.col("source") == s.source, classify.audience("url", "page.title", "page.breadcrumb", list(config.audience_rules), dict(config.audience_by_domain), s.default_audience)) for s in config.sources), F.lit("todas"))
    topics = F.coalesce(*(F.when(F.col("source") == s.source, classify.topic("url", "page.title", "page.breadcrumb", list(config.topic_rules), s.default_topic)) for s in config.sources), F.lit("otros"))
    documents = base.filter("NOT _copy").select("id", "url", F.col("page.title").alias("title"), audiences.alias("audience"), topics.alias("topic"), F.col("page.text").alias("text"), F.coalesce("page.updated_at", "lastmod").alias("updated_at"), "source", F.col("page.faqs").alias("_faqs"))
    chunks = chunking.chunk_documents(documents.select("id", "audience", "topic", "url", "text"), id_col="id", least=d.min_words, most=d.max_words, overlap=d.overlap_words).select(F.col("chunk_id").alias("id"), F.col("id").alias("document_id"), F.col("piece").alias("text"), "audience", "topic", "url")
    faqs = documents.select(F.explode("_faqs").alias("f"), "audience", "topic", "url").select("f.question", "f.answer", "audience", "topic", "url")
    rejected = excluded.unionByName(joined.filter("reason IS NOT NULL").select("url", "reason", "source")).unionByName(read.filter("reason IS NOT NULL").select("url", "reason", "source")).unionByName(base.filter("_copy").select("url", F.lit("duplicate").alias("reason"), "source"))
    return WebCorpus(documents.drop("_faqs"), chunks, faqs, rejected)
