"""URLs: canonical form and the ordered rules that accept or reject them, as columns.

Rules are data: a ``SiteRules`` per source. Deciding is one CASE; rule arrays are literals, so nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LOGIN_MARKERS, NON_HTML_EXTENSIONS, PDF_EXTENSION, TRACKING_PARAMS
from ..functions.text import col, strip_edges

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


@dataclass(frozen=True)
class SiteRules:
    """What one source takes: exact paths, path prefixes and patterns, less the exclusions."""

    source: str
    domain: str
    exclude: tuple[str, ...] = ()
    urls: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    default_audience: str = "todas"
    default_topic: str = "otros"


def url_part(c: Column | str, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty where absent."""
    return F.regexp_extract(strip_edges(c), _SPLIT, n)


def _requoted(c: Column) -> Column:
    """Decoded and encoded again, so that equal values are spelt alike."""
    spelt = F.url_encode(F.coalesce(F.try_url_decode(c), c))
    return F.replace(F.replace(spelt, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(c: Column | str) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameter or closing slash; parameters sorted."""
    scheme = F.coalesce(F.nullif(F.lower(url_part(c, 1)), F.lit("")), F.lit("https"))
    host = F.lower(url_part(c, 2))
    host = F.when((scheme == "https") & host.endswith(":443") | (scheme == "http") & host.endswith(":80"), F.regexp_replace(host, ":[0-9]+$", "")).otherwise(host)
    path = F.coalesce(F.nullif(F.regexp_replace(url_part(c, 3), "/+$", ""), F.lit("")), F.lit("/"))
    pairs = F.transform(
        F.filter(F.split(url_part(c, 4), "&"), lambda p: p != ""),
        lambda p: F.struct(_requoted(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _requoted(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_key(c: Column | str) -> Column:
    """The first 16 hex digits of the canonical URL's SHA-1."""
    return F.substring(F.sha1(canonical_url(c)), 1, 16)


def extension(path: Column | str) -> Column:
    """``.ext`` of the last path segment in lower case, or the empty text."""
    return F.lower(F.regexp_extract(F.element_at(F.split(col(path), "/"), -1), r"(\.[^.]*)$", 1))


def haystack(c: Column | str) -> Column:
    """Lower-case path and query: what patterns are looked up in."""
    query = url_part(c, 4)
    return F.lower(F.concat(url_part(c, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _rule_path(path: str) -> str:
    path = path.strip().lower()
    return ("/" + path.lstrip("/")).rstrip("/") or "/"


def _first(values: tuple[str, ...], holds) -> Column:
    """The first of the values that holds, or null."""
    return F.coalesce(*(F.when(holds(v), F.lit(v)) for v in values)) if values else F.lit(None).cast("string")


def decision(canon: Column, path: Column, host: Column, hay: Column, rules: SiteRules, global_exclude: tuple[str, ...] = ()) -> Column:
    """struct(url, accepted, rule, reason) of a canonical URL and its parts: the first of eight steps that applies."""
    ext = extension(path)
    plain = F.coalesce(F.nullif(F.regexp_replace(F.lower(path), "/+$", ""), F.lit("")), F.lit("/"))
    steps = [
        ("pdf", F.when(ext == PDF_EXTENSION, "pdf_extension"), False),
        ("non_html", F.when(ext.isin(*NON_HTML_EXTENSIONS), F.concat(F.lit("non_html_extension:"), ext)), False),
        ("excluded_by_rule", F.when(host != rules.domain.lower(), F.concat(F.lit("wrong_domain:"), host)), False),
        ("login", F.when(_first(LOGIN_MARKERS, hay.contains).isNotNull(), "login_area"), False),
        ("excluded_by_rule", F.concat(F.lit("global_exclude:"), _first(tuple(p.lower() for p in global_exclude), hay.contains)), False),
        ("excluded_by_rule", F.concat(F.lit("exclude_pattern:"), _first(rules.exclude, lambda p: hay.contains(p.lower()))), False),
        (None, F.concat(F.lit("include_url:"), _first(rules.urls, lambda p: plain == _rule_path(p))), True),
        (None, F.concat(F.lit("include_prefix:"), _first(rules.prefixes, lambda p: hay.startswith(p.lower()))), True),
        (None, F.concat(F.lit("include_pattern:"), _first(rules.patterns, lambda p: hay.contains(p.lower()))), True),
        ("excluded_by_rule", F.lit("default_reject"), False),
    ]
    hit = F.coalesce(*(F.when(rule.isNotNull(), F.struct(rule.alias("rule"), F.lit(accepted).alias("accepted"), F.lit(reason).cast("string").alias("reason"))) for reason, rule, accepted in steps))
    return F.struct(canon.alias("url"), hit["accepted"].alias("accepted"), hit["rule"].alias("rule"), hit["reason"].alias("reason"))


def followable(decided: Column) -> Column:
    """Whether a page may be visited for its links: accepted, or rejected by nothing but the default."""
    return decided["accepted"] | (decided["rule"] == "default_reject")


def decide(pages: DataFrame, sites: list[SiteRules], *, url: str = "url", source: str | None = None, global_exclude: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with ``decision``; with a source column each row follows its own source's rules, others the first site's."""
    # the URL is parsed once, in projections of its own, however many rules ask for its parts
    base = pages.withColumn("_canon", canonical_url(url))
    base = base.select("*", url_part("_canon", 2).alias("_host"), url_part("_canon", 3).alias("_path"), haystack("_canon").alias("_hay"))
    cases = [(s, decision(F.col("_canon"), F.col("_path"), F.col("_host"), F.col("_hay"), s, global_exclude)) for s in sites]
    chosen = cases[0][1] if source is None else F.coalesce(*(F.when(F.col(source) == s.source, d) for s, d in cases))
    return base.withColumn("decision", chosen).drop("_canon", "_host", "_path", "_hay")


def rule_counts(decided: DataFrame) -> DataFrame:
    """(rule, reason, n), most frequent first."""
    return decided.groupBy(F.col("decision.rule").alias("rule"), F.col("decision.reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")
