"""Rule-like scalar functions of catalogue records: status, marks, headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import HEADING_ONLY, INACTIVE_MARKERS
from .text import col, match_key, squeeze, strip_edges

_BARE = "(?iu)(?:" + "|".join(HEADING_ONLY) + ")"


def status(c: Column | str) -> Column:
    """struct(is_active, status_type, status_detail) of a status text: removal is told first, texts of no known kind stay active."""
    detail = F.nullif(strip_edges(c), F.lit(""))
    loud = F.upper(detail)
    removed, replaced = (loud.contains(x) for x in INACTIVE_MARKERS)
    kind = F.when(detail.isNull(), "vigente_en_documento").when(removed, "eliminado").when(replaced, "reemplazado_por_servicio").otherwise("estado_no_clasificado")
    return F.struct(kind.isin("vigente_en_documento", "estado_no_clasificado").alias("is_active"), kind.alias("status_type"), detail.alias("status_detail"))


def has_mark(c: Column | str) -> Column:
    """Whether a lone X stands in a cell."""
    return F.coalesce(match_key(c).rlike(r"(^| )X($| )"), F.lit(False))


def heading_only(c: Column | str) -> Column:
    """Whether a chunk is nothing but a heading."""
    return F.coalesce(squeeze(c).rlike(_BARE), F.lit(False))


def is_question(c: Column | str) -> Column:
    t = squeeze(c)
    return F.coalesce(F.length(t).between(8, 300) & (t.endswith("?") | t.startswith("¿")), F.lit(False))


def column_header(cells: Column | str, keywords: tuple[str, ...], least: int = 2) -> Column:
    """Whether a row of cells names at least so many of the keywords."""
    line = match_key(F.array_join(col(cells), " "))
    return sum((line.contains(k).cast("int") for k in keywords), F.lit(0)) >= least
