"""Sections of long catalogue fields: official sub-procedures and known headings, then packs of paragraphs under each.

Plain functions of one text, for use in Arrow or Python UDFs: which line is a heading depends on the record's own sub-procedures.
"""

from __future__ import annotations

import re
import unicodedata

from ..fixed import KNOWN_HEADINGS, PLAIN_CODE, SUB_LINE
from .chunking import pack_paragraphs, tokens

_DOTTED = re.compile(SUB_LINE, re.I | re.S)
_SIGN = re.compile(r"N\.?°")


def clean(text: str | None) -> str:
    """NFKC; control characters and tabs are spaces; spaces are squeezed per line; two line ends at most in a row."""
    if text is None:
        return ""
    text = re.sub("\r\n?", "\n", unicodedata.normalize("NFKC", text))
    text = "".join(c if c == "\n" or c >= " " else " " for c in text)
    lines = [re.sub(" +", " ", x.replace("\xa0", " ")).strip() for x in text.split("\n")]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def key(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFD", clean(text)) if unicodedata.category(c) != "Mn").upper()
    return re.sub("[^A-Z0-9]+", " ", plain).strip()


def code(text: str) -> str:
    """A dotted code: the first part as a catalogue code, numbers without leading zeros."""
    parts = clean(text).upper().split(".")
    m = re.match(PLAIN_CODE, _SIGN.sub("", parts[0]).strip(" .|"))
    head = (f"{int(m[1])}-{m[2]}" if m[2] else str(int(m[1]))) if m else parts[0]
    return ".".join([head, *(str(int(p)) if p.isdigit() else p for p in parts[1:])])


def official(line: str, subs: list[tuple[str, str]]) -> tuple[str, str] | None:
    """(code, title) of the sub-procedure of the index whose code the line begins with; the last of equal codes."""
    m = _DOTTED.match(clean(line))
    if not m:
        return None
    return {code(c): (clean(c), clean(t)) for c, t in subs if clean(c)}.get(code(m[1]))


def is_heading(line: str, subs: list[tuple[str, str]], more: tuple[str, ...] = ()) -> bool:
    k = key(line)
    if not k:
        return False
    return official(line, subs) is not None or len(line.split()) <= 35 and any(k == h or k.startswith(h + " ") for h in (*KNOWN_HEADINGS, *more))


def sections(text: str, subs: list[tuple[str, str]], more: tuple[str, ...] = ()) -> list[tuple[str | None, str]]:
    """(heading, body with its heading) in order; ``more`` are headings besides the known ones, as match keys."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in map(clean, clean(text).splitlines()):
        if line and is_heading(line, subs, more):
            out.append((line, []))
        else:
            out[-1][1].append(line)
    found = [(h, clean("\n".join(([h] if h else []) + ([b] if (b := clean("\n".join(lines))) else [])))) for h, lines in out]
    return [(h, b) for h, b in found if b]


def named_sub(text: str, subs: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    """The sub-procedure a heading names: by code, else by its whole title."""
    if not text:
        return None, None
    if (found := official(text, subs)) is not None:
        return found
    k = key(text)
    return next(((clean(c), clean(t)) for c, t in subs if clean(t) and key(t) in k), (None, None))


def packed_sections(body: str, subs, head: str, semantic: bool, target: int, most: int, more: tuple[str, ...] = ()) -> list[dict]:
    """Packs of a field: by section and paragraph if semantic, else as one unit; the header's tokens count against the limits."""
    pairs = [(s["code"] or "", s["title"] or "") for s in subs or ()]
    body, out = clean(body), []
    for heading, text in (sections(body, pairs, more) or [(None, body)]) if semantic else [(None, body)]:
        sub = named_sub(heading or text[:250], pairs) if semantic else (None, None)
        used = tokens(head or "") + (tokens(f"Subprocedimiento: {sub[0]} - {sub[1] or ''}") if sub[0] else 0) + 8
        limit = max(40, most - used - 4)
        goal = max(30, min(limit, target - used - 4))
        units = [p for p in map(clean, re.split(r"\n\s*\n", text)) if p] if semantic else [text]
        out += [{"code": sub[0], "title": sub[1], "text": x} for x in map(clean, pack_paragraphs(units or [text], target=goal, most=limit)) if x]
    return out
