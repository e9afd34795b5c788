"""Text as columns: folding, counting, hashing, codes and slugs. All of it stays in the JVM.

White space and word classes are Unicode's (``(?U)``), as Python's are. A null in gives a null out unless stated.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import PLAIN_CODE, SERVICE_CODE, SUB_LINE, TAX_ID, TAX_ID_WEIGHTS, TOKEN

SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


@cache
def accent_map() -> tuple[str, str]:
    """Letters of the basic plane that decompose to one base letter and marks, and those letters."""
    source, target = [], []
    for point in range(0xC0, min(sys.maxunicode, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(point):
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_edges(c: Column | str) -> Column:
    return F.regexp_replace(col(c), EDGES, "")


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; edges go."""
    return strip_edges(F.regexp_replace(col(c), SPACE, " "))


def strip_accents(c: Column | str) -> Column:
    source, target = accent_map()
    t = col(c)
    return F.when(t.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(t, source, target), r"\p{Mn}", "")).otherwise(t)


def match_key(c: Column | str) -> Column:
    """Accent-free upper case; all but A-Z and 0-9 are single spaces."""
    return F.trim(F.regexp_replace(F.upper(strip_accents(c)), "[^A-Z0-9]+", " "))


def folded(c: Column | str) -> Column:
    """Accent-free lower case."""
    return strip_accents(F.lower(col(c)))


def word_count(c: Column | str) -> Column:
    return F.coalesce(F.regexp_count(col(c), F.lit(r"(?U)\S+")), F.lit(0))


def token_count(c: Column | str) -> Column:
    """Words, and each other visible sign, count one."""
    return F.coalesce(F.regexp_count(col(c), F.lit("(?U)" + TOKEN)), F.lit(0))


def token_estimate(c: Column | str) -> Column:
    """1.3 tokens a word, rounded half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(word_count(c) * F.lit(1.3)).cast("int"))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the text without white space at its edges."""
    return F.sha2(strip_edges(c), 256)


def fingerprint(c: Column | str) -> Column:
    """SHA-1 of the match key: equal for texts that differ in case, accents and punctuation only."""
    return F.sha1(match_key(c))


def slug(c: Column | str, separator: str = "_", longest: int = 80, empty: str = "item") -> Column:
    """Lower-case ASCII words joined by the separator, at most ``longest`` characters, ``empty`` if none are left."""
    plain = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", separator)
    cut = F.substring(F.regexp_replace(plain, f"^{separator}+|{separator}+$", ""), 1, longest)
    return F.coalesce(F.nullif(F.regexp_replace(cut, f"{separator}+$", ""), F.lit("")), F.lit(empty))


def path_slug(source: Column | str, path: Column | str, longest: int = 90) -> Column:
    """``source-path-words``; the root path is ``inicio``."""
    words = F.regexp_replace(F.regexp_replace(folded(path), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    tail = F.when(words == "", "inicio").otherwise(words)
    return F.regexp_replace(F.substring(F.concat(col(source), F.lit("-"), tail), 1, longest), "-+$", "")


def _plain_number(c: Column) -> Column:
    """Digits without leading zeros; zero stays."""
    return F.regexp_replace(c, "^0+(?=[0-9])", "")


def catalogue_code(c: Column | str) -> Column:
    """Codes without leading zeros: ``01`` is 1, ``08-A`` is 8-A, ``Servicio 01`` is SERVICIO 1, ``1.0`` is 1; others as they are.

    Upper case, without number signs, dots and bars at the edges go. Null is the empty code."""
    t = F.upper(F.coalesce(squeeze(c), F.lit("")))
    t = F.regexp_replace(t, r"^[ .|]+|[ .|]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"N\.?°", ""), SPACE, " ")
    t = F.regexp_replace(t, r"^([0-9]+)\.0+$", "$1")
    letter = F.regexp_extract(t, PLAIN_CODE, 2)
    return (
        F.when(t.rlike(PLAIN_CODE), F.concat(F.regexp_extract(t, PLAIN_CODE, 1), F.when(letter != "", F.concat(F.lit("-"), letter)).otherwise("")))
        .when(t.rlike(SERVICE_CODE), F.concat(F.lit("SERVICIO "), F.regexp_extract(t, SERVICE_CODE, 1)))
        .otherwise(t)
    )


def sub_code(c: Column | str) -> Column:
    """Dotted codes: the first part as a catalogue code, numbers in the others without leading zeros."""
    parts = F.split(F.upper(squeeze(c)), r"\.")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(p.rlike("^[0-9]+$"), _plain_number(p)).otherwise(p))
    return F.array_join(F.concat(F.array(catalogue_code(F.element_at(parts, 1))), rest), ".")


_SUB = "(?is)" + SUB_LINE


def sub_procedure(c: Column | str) -> Column:
    """struct(code, title) of a line that begins with a dotted code; null for any other line."""
    t = strip_edges(c)
    return F.when(t.rlike(_SUB), F.struct(sub_code(F.regexp_extract(t, _SUB, 1)).alias("code"), strip_edges(F.regexp_extract(t, _SUB, 2)).alias("title")))


def tax_id_valid(c: Column | str) -> Column:
    """Eleven digits, a known kind in front, and a modulo-11 check digit; null gives false."""
    t = strip_edges(c)
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.try_element_at(F.split(t, ""), i).try_cast("int"))
    weights = F.array(*(F.lit(w) for w in TAX_ID_WEIGHTS))
    total = F.aggregate(F.zip_with(digits, weights, lambda d, w: d * w), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    rest = F.lit(11) - total % 11
    check = F.when(rest == 10, 0).when(rest == 11, 1).otherwise(rest)
    shaped = t.rlike(TAX_ID)
    return F.coalesce(shaped & (F.substring(t, 11, 1).try_cast("int") == check), F.lit(False))
