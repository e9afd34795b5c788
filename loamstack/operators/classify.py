"""Audience and topic of a page by ordered rules over its URL, title and breadcrumb, as columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col, folded
from .urls import url_part

WEIGHTS = (3, 2, 1)


@dataclass(frozen=True)
class LabelRule:
    label: str
    patterns: tuple[str, ...]


def _plain(text: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def at_word_start(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern stands at the start of a word of an already folded text."""
    if not patterns:
        return F.lit(False)
    return text.rlike("(?<![a-z0-9])(?:" + "|".join(re.escape(_plain(p)) for p in patterns) + ")")


def signals(url: Column | str, title: Column | str, crumb: Column | str) -> tuple[Column, Column, Column]:
    """Folded (path and query, title, breadcrumb)."""
    text = lambda c: folded(F.coalesce(col(c), F.lit("")))
    return text(F.concat_ws(" ", url_part(url, 3), url_part(url, 4))), text(title), text(crumb)


def audience(url, title, crumb, rules: list[LabelRule], by_domain: dict[str, str] | None = None, default: str = "todas") -> Column:
    """The first rule that matches anywhere, else the host's audience, else the default."""
    hay = F.concat_ws(" ", *signals(url, title, crumb))
    host = F.lower(url_part(url, 2))
    steps = [F.when(at_word_start(hay, r.patterns), F.lit(r.label)) for r in rules]
    steps += [F.when(host == d, F.lit(a)) for d, a in (by_domain or {}).items()]
    return F.coalesce(*steps, F.lit(default))


def topic(url, title, crumb, rules: list[LabelRule], default: str = "otros") -> Column:
    """The best score wins: URL 3, title 2, breadcrumb 1, each once per rule; ties go to the earlier rule, no score to the default."""
    parts = signals(url, title, crumb)
    if not rules:
        return F.lit(default)
    scored = F.array(*(F.struct(sum((F.when(at_word_start(t, r.patterns), w).otherwise(0) for t, w in zip(parts, WEIGHTS, strict=True)), F.lit(0)).alias("score"), F.lit(-i).alias("ord"), F.lit(r.label).alias("label")) for i, r in enumerate(rules)))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["label"]).otherwise(default)
