"""Configuration of a web corpus: defaults, sources and classification rules, from YAML or mappings, checked when read."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from .operators.classify import LabelRule
from .operators.urls import SiteRules

AUDIENCES = ("personas", "empresas", "emprendedores", "todas")


@dataclass(frozen=True)
class Defaults:
    min_chars: int = 400
    max_link_ratio: float = 0.5
    min_words: int = 250
    max_words: int = 450
    overlap_words: int = 40
    requests_per_second: float = 1.0
    max_retries: int = 3
    timeout_seconds: float = 30.0
    user_agent: str = "loamstack"
    respect_robots: bool = True

    def __post_init__(self) -> None:
        if not 0 < self.min_words <= self.max_words or self.overlap_words < 0 or not 0 <= self.max_link_ratio <= 1 or self.requests_per_second <= 0:
            raise ValueError("defaults are out of range")


@dataclass(frozen=True)
class Config:
    defaults: Defaults = field(default_factory=Defaults)
    global_exclude: tuple[str, ...] = ()
    sources: tuple[SiteRules, ...] = ()
    audience_rules: tuple[LabelRule, ...] = ()
    audience_by_domain: Mapping[str, str] = field(default_factory=dict)
    topic_rules: tuple[LabelRule, ...] = ()

    def source(self, name: str) -> SiteRules:
        for s in self.sources:
            if s.source == name:
                return s
        raise KeyError(f"no source {name!r}; there are {', '.join(s.source for s in self.sources) or 'none'}")

    def selected(self, name: str | None = None) -> list[SiteRules]:
        return list(self.sources) if name is None else [self.source(name)]


def _known(kind: type, given: Mapping) -> dict:
    names = {f.name for f in fields(kind)}
    if extra := set(given) - names:
        raise ValueError(f"unknown settings {sorted(extra)} for {kind.__name__}")
    return {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}


def from_mapping(raw: Mapping, environment: Mapping[str, str] | None = None) -> Config:
    """Environment variables LOAMSTACK_RPS, LOAMSTACK_USER_AGENT and LOAMSTACK_TIMEOUT go before the file's values."""
    env = os.environ if environment is None else environment
    defaults = dict(raw.get("defaults") or {})
    for key, name, kind in (("LOAMSTACK_RPS", "requests_per_second", float), ("LOAMSTACK_USER_AGENT", "user_agent", str), ("LOAMSTACK_TIMEOUT", "timeout_seconds", float)):
        if env.get(key):
            defaults[name] = kind(env[key])
    rules = raw.get("classification") or {}
    audiences = tuple(LabelRule(r["label"], tuple(r["patterns"])) for r in rules.get("audience_rules") or ())
    named = {r.label for r in audiences} | {x.get("default_audience", "todas") for x in raw.get("sources") or ()}
    if named - set(AUDIENCES):
        raise ValueError(f"unknown audiences {sorted(named - set(AUDIENCES))}")
    return Config(
        Defaults(**_known(Defaults, defaults)), tuple(raw.get("global_exclude") or ()), tuple(SiteRules(**_known(SiteRules, s)) for s in raw.get("sources") or ()),
        audiences, dict(rules.get("audience_by_domain") or {}), tuple(LabelRule(r["label"], tuple(r["patterns"])) for r in rules.get("topic_rules") or ()),
    )


def load(path: str | Path) -> Config:
    import yaml

    return from_mapping(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
