"""Personal data and credentials in messages: nine reasons as columns, in a fixed order.

Credentials are looked for in folded text (accents gone, common digit disguises undone, spaces squeezed) and, for a few strong
words, with all spacing taken out. Numbers are looked for in the text as it is. Tax numbers are public and never a reason.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import ACCOUNT_NUMBER, CARD_NUMBER, CREDENTIAL_TIGHT, CREDENTIAL_WORDS, DISGUISES, EMAIL, IDENTITY_NUMBER, MOBILE_NUMBER, SENSITIVE, SOL_KEY, USER_WITH_VALUE
from ..functions.text import col, folded

_MENTION, _LOGIN, _CARE = r"(?iU)\b(?:" + CREDENTIAL_WORDS + r")\b", "(?iU)" + USER_WITH_VALUE, "(?iU)" + SENSITIVE
#: An address is looked for from the start of a run of its signs only, so a long run is read once, not once from each place.
_ADDRESS = r"(?<![A-Za-z0-9._%+\-])" + EMAIL
#: White space but for single spaces, which may stay as they are.
_RUNS = r"(?U)\s{2,}|[^\S ]"
#: One of these is in whatever matches; besides ASCII, only the signs in _ODD match an ASCII letter where case does not count.
_ODD = ("ſ", "ı", "İ", "\u212a")
_MENTIONED = ("clave", "contrasen", "pass", "pin", "codigo", "otp", "token", "usuario", "user", "credencial", *_ODD)
_LOGGED, _CARED = ("usuario", "user", "login", "nick", "cuenta", *_ODD), ("mi ", "mis ", *_ODD)
REASONS = ("clave_sol", "credencial", "usuario", "cuenta_bancaria", "tarjeta", "celular", "dni", "email", "dato_sensible")


def unmasked(c: Column | str) -> Column:
    """Folded text with digit disguises undone and spaces squeezed (not trimmed)."""
    plain = folded(c)
    for sign, letter in zip(*DISGUISES, strict=True):  # no letter is itself a disguise
        plain = F.replace(plain, F.lit(sign), F.lit(letter))
    return F.regexp_replace(plain, _RUNS, " ")


def card_numbers(c: Column | str) -> Column:
    """Runs of 13 to 19 digits, spaces and hyphens between them allowed, that pass the Luhn check."""
    runs = F.transform(F.regexp_extract_all(col(c), F.lit(CARD_NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"[ \-]", ""))
    return F.filter(runs, lambda x: F.length(x).between(13, 19) & F.call_function("luhn_check", x))


def _without(t: Column, signs: str) -> Column:
    for sign in signs:
        t = F.replace(t, F.lit(sign))
    return t


def _any(t: Column, parts: Iterable[str]) -> Column:
    """Whether a part is in the text: a fraction of the cost of a pattern, so patterns are tried only on texts that can match."""
    return reduce(or_, (t.contains(p) for p in parts))


def _views(t: Column) -> dict[str, Column]:
    """The three readings of a text that the rules look at."""
    return {"_plain": unmasked(t), "_joined": _without(t, " -")}


def _reasons(t: Column, plain: Column, joined: Column, tight: Column) -> Column:
    key = plain.contains("clave") & plain.rlike("(?U)" + SOL_KEY) | tight.contains("clavesol")
    long = joined.rlike("[0-9]{13}")
    account = long & joined.rlike(ACCOUNT_NUMBER)
    holds = {
        "clave_sol": key,
        "credencial": ~key & (_any(plain, _MENTIONED) & plain.rlike(_MENTION) | _any(tight, CREDENTIAL_TIGHT.split("|"))),
        "usuario": _any(plain, _LOGGED) & plain.rlike(_LOGIN),
        "cuenta_bancaria": account,
        "tarjeta": long & (F.size(card_numbers(t)) > 0),
        "celular": t.contains("9") & t.rlike("(?U)" + MOBILE_NUMBER),
        "dni": ~account & joined.rlike(IDENTITY_NUMBER),
        "email": t.contains("@") & t.rlike(_ADDRESS),
        "dato_sensible": _any(plain, _CARED) & plain.rlike(_CARE),
    }
    return F.array_compact(F.array(*(F.when(holds[r], F.lit(r)) for r in REASONS)))


def _tight(plain: Column) -> Column:
    return _without(plain, " ._-")  # its only white space are spaces


def reasons(c: Column | str) -> Column:
    """array<string>: the reasons that hold, in order; empty for null and blank text."""
    t = F.coalesce(col(c), F.lit(""))
    v = _views(t)
    return _reasons(t, v["_plain"], v["_joined"], _tight(v["_plain"]))


def verdict_of(found: Column) -> Column:
    """struct(blocked, reasons, safe_label) of reasons: the label is fit for logs, it holds nothing of the text."""
    some = F.size(found) > 0
    return F.struct(some.alias("blocked"), found.alias("reasons"), F.when(some, F.concat(F.lit("BLOQUEADO["), F.array_join(found, ","), F.lit("]"))).otherwise("OK").alias("safe_label"))


def verdict(c: Column | str) -> Column:
    return verdict_of(reasons(c))


def inspected(rows: DataFrame, *, text: str = "text", name: str = "verdict") -> DataFrame:
    """``rows`` with the verdict. The readings of a text are columns of their own, so each is made once per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = rows.withColumns(_views(t)).withColumn("_tight", _tight(F.col("_plain")))
    found = base.withColumn("_found", _reasons(t, F.col("_plain"), F.col("_joined"), F.col("_tight")))
    return found.withColumn(name, verdict_of(F.col("_found"))).drop("_plain", "_joined", "_tight", "_found")


def is_safe(c: Column | str) -> Column:
    return F.size(reasons(c)) == 0


_SPOKEN = {
    "clave_sol": "una Clave SOL", "credencial": "una clave, un PIN o un token", "usuario": "un usuario", "dni": "un DNI", "tarjeta": "una tarjeta",
    "cuenta_bancaria": "una cuenta bancaria", "email": "un correo", "celular": "un celular", "dato_sensible": "un dato sensible",
}


def awareness(found: Column | str) -> Column:
    """The reply to a blocked message: what was found, without repeating it; null where nothing was."""
    spoken = F.transform(col(found), lambda r: F.element_at(F.create_map(*[F.lit(x) for kv in _SPOKEN.items() for x in kv]), r))
    more = F.slice(spoken, 2, F.greatest(F.size(spoken) - 1, F.lit(0)))
    extra = F.when(F.size(more) > 0, F.concat(F.lit(" (y también "), F.array_join(more, ", "), F.lit(")"))).otherwise("")
    return F.when(F.size(col(found)) > 0, F.concat(F.lit("Tu mensaje no se procesó: parece contener "), F.try_element_at(spoken, F.lit(1)), extra, F.lit(". Quita esos datos y vuelve a preguntar.")))
