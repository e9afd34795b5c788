"""Catalogue reconstruction: sheet and table rows become entries, groups, parent records and chunks.

Rows carry state from row to row (section, category, current code). That is a forward fill: each row says what it changes, and
``last`` over the rows before it says what holds. A window over one whole sheet is one task, so every window is partitioned by
``sheet`` (a source file or table): sheets are independent, and there are as many tasks as sheets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import CATALOGUE_COLUMNS, COLUMN_HEADERS, FIELD_LABELS, GROUPED_FIELDS, INLINE_NOTE, LAW_LINE, LEGAL_MARKER, LONG_FIELDS, MARK_LABELS, STATUS_NOTES
from ..functions.flags import column_header, has_mark
from ..functions.text import catalogue_code, fingerprint, match_key, slug, squeeze, strip_edges, sub_procedure, token_count

COLUMNS, LABELS, MARKS = CATALOGUE_COLUMNS, FIELD_LABELS, MARK_LABELS
_ORDER = tuple(LABELS)
_NOTE, _LEGAL, _LAW = "(?is)" + INLINE_NOTE, "(?iu)" + LEGAL_MARKER, "(?miu)" + LAW_LINE


@dataclass(frozen=True)
class Wording:
    """What an agency calls itself and its catalogue: texts that open records and chunks, and the keys that headers hold."""

    banner: str = "Catálogo de procedimientos"
    procedure: str = "Procedimiento"
    service: str = "Servicio"
    id_prefix: str = "proc_"
    procedure_type: str = "procedimiento"
    agency: str = ""
    headings: tuple[str, ...] = ()

    def entity(self, code: Column) -> Column:
        return F.when(code.startswith("SERVICIO "), self.service).otherwise(self.procedure)


PLAIN = Wording()


def filled(event: Column, w) -> Column:
    """The last event up to this row: structs, so that an event may set a value to null."""
    return F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def title_and_status(c: Column | str) -> Column:
    """struct(title, status): notes of change are split off, by line or from closing brackets."""
    t = strip_edges(c)
    lines = F.split(t, "\n")
    noted = F.transform(lines, lambda x: sum((match_key(x).contains(k).cast("int") for k in STATUS_NOTES), F.lit(0)) > 0)
    at = F.array_position(noted, True)
    before = F.regexp_replace(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0)).cast("int")), " "), r"^[() ]+|[() ]+$", "")
    after = F.array_join(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.size(lines)), " ")
    inline = F.regexp_extract(t, _NOTE, 0)
    return (
        F.when(at > 0, F.struct(F.when(before == "", t).otherwise(before).alias("title"), F.trim(after).alias("status")))
        .when(inline != "", F.struct(strip_edges(F.regexp_replace(t, _NOTE, "")).alias("title"), F.regexp_replace(inline, r"^[\s()]+|[\s()]+$", "").alias("status")))
        .otherwise(F.struct(t.alias("title"), F.lit(None).cast("string").alias("status")))
    )


def parse_index(rows: DataFrame, *, sheet: str = "sheet", row: str = "row", code: str = "code", title: str = "title") -> DataFrame:
    """Index rows with kind (section, category, entry, sub), section, category and entry code; headers and blank rows are gone."""
    t, key = strip_edges(title), match_key(title)
    own = catalogue_code(code)
    base = rows.withColumn("_t", t).filter((F.coalesce(F.col("_t"), F.lit("")) != "") & ~match_key(F.coalesce(F.col(code), F.lit(""))).contains("NUMERO DEL PROCEDIMIENTO") & ~key.contains("NOMBRE DEL PROCEDIMIENTO ADMINISTRATIVO") & ~key.startswith("NOV 2018"))
    base = base.withColumn("_c", F.nullif(own, F.lit(""))).withColumn("_s", sub_procedure("_t"))
    w = Window.partitionBy(sheet).orderBy(row)
    # A dotted line belongs to the entry before it only if nothing but its own subs stands between: sections and foreign titles end it.
    # Whether such a line is a sub depends on the entry before, so breaks are found against the last coded row first.
    section = F.col("_c").isNull() & key.startswith("SECCION ")
    base = base.withColumn("_section", section).withColumn("_coded", filled(F.when(F.col("_c").isNotNull() | F.col("_section"), F.struct(F.col("_c").alias("c"))), w)["c"])
    fits = F.col("_s").isNotNull() & (F.element_at(F.split(F.col("_s.code"), r"\."), 1) == F.col("_coded"))
    base = base.withColumn("_breaks", F.col("_c").isNull() & ~F.coalesce(fits, F.lit(False)))
    base = base.withColumn("_entry", filled(F.when(F.col("_c").isNotNull() | F.col("_breaks"), F.struct(F.col("_c").alias("c"))), w)["c"])
    kind = F.when(F.col("_c").isNotNull(), "entry").when(F.col("_section"), "section").when(F.coalesce(fits, F.lit(False)) & F.col("_entry").isNotNull(), "sub").otherwise("category")
    base = base.withColumn("kind", kind)
    base = base.withColumn("section", filled(F.when(F.col("kind") == "section", F.struct(F.col("_t").alias("v"))), w)["v"])
    base = base.withColumn("category", filled(F.when(F.col("kind") == "section", F.struct(F.lit(None).cast("string").alias("v"))).when(F.col("kind") == "category", F.struct(F.col("_t").alias("v"))), w)["v"])
    named = title_and_status("_t")
    return base.select(
        sheet, row, "kind", F.when(F.col("kind").isin("entry", "sub"), F.col("_entry")).alias("code"), "section", "category",
        F.when(F.col("kind") == "entry", named["title"]).when(F.col("kind") == "sub", F.col("_s.title")).otherwise(F.col("_t")).alias("title"),
        F.when(F.col("kind") == "entry", named["status"]).alias("status"), F.when(F.col("kind") == "sub", F.col("_s.code")).alias("sub_code"), F.col("_t").alias("raw_title"),
    )


def entries(index_rows: DataFrame, *, sheet: str = "sheet", row: str = "row") -> DataFrame:
    """One row per catalogue entry with its sub-procedures in order; a code that occurs twice in a sheet raises an error when read."""
    subs = index_rows.filter("kind = 'sub'").groupBy(sheet, "code").agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("source_row"), F.col("sub_code").alias("code"), "title", "raw_title"))).alias("subprocedures"))
    one = index_rows.filter("kind = 'entry'").groupBy(sheet, "code").agg(F.count("*").alias("_n"), F.min(F.struct(row, "title", "raw_title", "section", "category", "status")).alias("_e"))
    checked = one.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate code in the index: "), F.col("code")))).otherwise(F.lit(True))).filter("_ok")
    return checked.join(subs, [sheet, "code"], "left").select(sheet, "code", "_e.title", "_e.raw_title", "_e.section", "_e.category", "_e.status", F.col(f"_e.{row}").alias("source_row"), F.coalesce("subprocedures", F.expr("array()")).alias("subprocedures"))


def group_rows(rows: DataFrame, known: DataFrame, *, sheet: str = "sheet", table: str = "table_index", row: str = "row_index", cells: str = "cells", wording: Wording = PLAIN) -> DataFrame:
    """Table rows with state (header, blank, owner, continuation, unknown, orphan) and the code of the procedure they belong to.

    ``known`` (sheet, code, title) is the index. A row with a known code opens a group, rows without a code continue it, headers and
    unknown codes end it; after a service header, 1 to 4 stand for services, and services are found by title too."""
    head = match_key(F.array_join(F.slice(cells, 1, 2), " "))
    service = head.contains(wording.agency) & head.contains("SERVICIOS PRESTADOS EN EXCLUSIVIDAD")
    catalogue = head.contains(wording.agency) & head.contains("TEXTO UNICO DE PROCEDIMIENTOS ADMINISTRATIVOS")
    w = Window.partitionBy(sheet).orderBy(table, row)
    base = rows.withColumn("_header", service | catalogue | column_header(cells, COLUMN_HEADERS))
    base = base.withColumn("_mode", F.coalesce(filled(F.when(service, "service").when(catalogue, "procedure"), w), F.lit("procedure")))
    base = base.withColumn("_blank", ~F.col("_header") & ~F.exists(cells, lambda x: F.coalesce(x, F.lit("")) != ""))
    raw = catalogue_code(F.try_element_at(cells, F.lit(1)))
    base = base.withColumn("_raw", raw)
    wanted = F.when(F.col("_mode") == "service", F.when(F.col("_raw").rlike("^[1-4]$"), F.concat(F.lit("SERVICIO "), F.col("_raw")))).otherwise(F.col("_raw"))
    base = base.withColumn("_wanted", wanted)
    codes = known.select(F.col(sheet).alias("_ks"), F.col("code").alias("_known"))
    base = base.join(codes, (F.col(sheet) == F.col("_ks")) & (F.col("_wanted") == F.col("_known")), "left")
    # services by title: the few service entries of a sheet travel as one array, and the first in index order wins
    titles = known.filter(F.col("code").startswith("SERVICIO ")).select(F.col(sheet).alias("_ts"), F.struct("source_row", "code", match_key("title").alias("key")).alias("_x")).groupBy("_ts").agg(F.array_sort(F.collect_list("_x")).alias("_titles"))
    base = base.join(titles, F.col(sheet) == F.col("_ts"), "left").withColumn("_name", match_key(F.try_element_at(cells, F.lit(2))))
    by_title = F.try_element_at(F.filter(F.coalesce("_titles", F.expr("array()").cast("array<struct<source_row:int,code:string,key:string>>")), lambda x: (F.col("_name") != "") & (x["key"] != "") & (F.col("_name").startswith(x["key"]) | x["key"].startswith(F.substring("_name", 1, 80)))), F.lit(1))["code"]
    base = base.withColumn("_code", F.when(~F.col("_header") & ~F.col("_blank"), F.coalesce("_known", F.when(F.col("_mode") == "service", by_title))))
    unknown = ~F.col("_header") & ~F.col("_blank") & F.col("_code").isNull() & (F.col("_raw") != "")
    base = base.withColumn("_unknown", unknown)
    current = filled(F.when(F.col("_code").isNotNull() | F.col("_header") | F.col("_unknown"), F.struct(F.col("_code").alias("c"))), w)["c"]
    base = base.withColumn("_current", current)
    state = F.when(F.col("_header"), "header").when(F.col("_blank"), "blank").when(F.col("_code").isNotNull(), "owner").when(F.col("_unknown"), "unknown").when(F.col("_current").isNotNull(), "continuation").otherwise("orphan")
    return base.withColumn("state", state).select(sheet, table, row, cells, "state", F.when(F.col("state").isin("owner", "continuation"), F.col("_current")).alias("code"), F.col("_raw").alias("raw_code"))


def ordered_distinct(items: Column) -> Column:
    """Texts of an array of struct(pos, text) in order, blank ones and repeats (by fingerprint) left out, joined by blank lines."""
    kept = F.filter(F.transform(F.array_sort(items), lambda x: F.struct(strip_edges(x["text"]).alias("t"), fingerprint(x["text"]).alias("f"))), lambda x: F.coalesce(x["t"], F.lit("")) != "")
    first = F.filter(F.transform(kept, lambda x, i: F.struct(x["t"].alias("t"), (F.array_position(F.transform(kept, lambda y: y["f"]), x["f"]) == i + 1).alias("n"))), lambda x: x["n"])
    return F.array_join(F.transform(first, lambda x: x["t"]), "\n\n")


def parents(grouped: DataFrame, index: DataFrame, *, sheet: str = "sheet", table: str = "table_index", row: str = "row_index", cells: str = "cells", wording: Wording = PLAIN) -> DataFrame:
    """One record per index entry that has rows: joined columns, flags, status, trace and a Markdown rendering."""
    owned = grouped.filter(F.col("code").isNotNull())
    pos = F.struct(F.col(table).alias("t"), F.col(row).alias("r"))
    joined = owned.groupBy(sheet, "code").agg(*(ordered_distinct(F.collect_list(F.struct(pos.alias("pos"), F.try_element_at(cells, F.lit(i)).alias("text")))).alias(name) for i, name in enumerate(COLUMNS[1:], start=2)), F.count("*").alias("row_count"))
    flags = F.struct(*(has_mark(c).alias(c) for c in MARKS))
    said = F.filter(F.array(*(F.when(has_mark(c), F.lit(t)) for c, t in MARKS.items())), lambda x: x.isNotNull())
    plain = F.array_distinct(F.filter(F.array(*(F.col(c) for c in MARKS)), lambda x: x != ""))
    name = F.col("denominacion_y_base_legal")
    record = index.join(joined, [sheet, "code"]).withColumn("calificacion", F.array_join(F.when(F.size(said) > 0, said).otherwise(plain), "; ")).withColumn("calification_flags", flags)
    rest = name
    # the title is taken off by its words, with any white space between them, so that the lines after it stay lines
    words = F.transform(F.split(squeeze("title"), " "), lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    title = F.concat(F.lit(r"(?iuU)\A\s*"), F.array_join(words, r"\s+"))
    begins = F.regexp_like(name, title) & (F.coalesce("title", F.lit("")) != "")
    record = record.withColumn("_rest", F.when(begins, strip_edges(F.regexp_replace(name, title, F.lit("")))).otherwise(rest))
    marker = F.col("_rest").rlike(_LEGAL)
    by_marker = F.split(F.col("_rest"), _LEGAL, 2)
    by_law = F.split(F.col("_rest"), f"(?={_LAW})", 2)
    record = record.withColumn("title_detected", F.when(begins, squeeze(F.regexp_substr(name, title))).otherwise(F.lit("")))
    record = record.withColumn("fundamento_legal", F.when(marker, strip_edges(F.try_element_at(by_marker, F.lit(2)))).when(F.col("_rest").rlike(_LAW), F.substring(F.col("_rest"), F.length(F.try_element_at(by_law, F.lit(1))) + 1, 1 << 30)).otherwise(F.lit("")))
    record = record.withColumn("denominacion_adicional", F.when(marker, strip_edges(F.try_element_at(by_marker, F.lit(1)))).when(F.col("_rest").rlike(_LAW), strip_edges(F.try_element_at(by_law, F.lit(1)))).otherwise(F.col("_rest")))
    everything = F.concat_ws("\n", *(F.col(c) for c in COLUMNS[1:]))
    told = F.try_element_at(F.filter(F.split(everything, "\n"), lambda x: match_key(x).contains("ELIMINADO")), F.lit(1))
    record = record.withColumn("status", F.coalesce("status", F.when(match_key(everything).contains("ELIMINADO MEDIANTE"), told)))
    service = F.col("code").startswith("SERVICIO ")
    heading = F.concat(F.lit("# "), wording.entity(F.col("code")), F.lit(" "), F.col("code"), F.lit(": "), F.col("title"))
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    subs = F.when(F.size("subprocedures") > 0, F.concat(F.lit("Subprocedimientos del índice:\n"), F.array_join(F.transform("subprocedures", lambda x: F.concat(F.lit("- "), x["code"], F.lit(": "), x["title"])), "\n")))
    body = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n## {LABELS[c]}\n"), F.col(c))) for c in _ORDER]
    record = record.withColumn("page_content", F.concat_ws("\n", heading, line("Sección", "section"), line("Categoría", "category"), line("Estado en la fuente", "status"), subs, *body))
    kind = F.when(service, "servicio_prestado_en_exclusividad").otherwise(wording.procedure_type)
    return record.select(sheet, F.concat(F.lit(wording.id_prefix), slug("code")).alias("id"), "code", "title", kind.alias("document_type"), "section", "category", "status", "source_row", "subprocedures", "calification_flags", F.struct(*(F.col(c) for c in _ORDER)).alias("fields"), "title_detected", "row_count", "page_content")


def chunk_parents(records: DataFrame, *, target: int = 450, most: int = 650, wording: Wording = PLAIN) -> DataFrame:
    """Chunks of parent records: long fields by paragraphs, short ones in groups, the whole record where nothing else is left."""
    from functools import partial

    from .sections import packed_sections

    present = lambda c: F.coalesce(F.col(f"fields.{c}"), F.lit("")) != ""
    specs = [F.when(present(c), F.struct(F.lit(i).alias("ord"), F.lit(c).alias("content_type"), F.lit(LABELS[c]).alias("content_label"), F.col(f"fields.{c}").alias("body"))) for i, c in enumerate(LONG_FIELDS)]
    for i, (name, label, fields) in enumerate(GROUPED_FIELDS, start=len(LONG_FIELDS)):
        body = F.concat_ws("\n\n", *(F.when(present(c), F.concat(F.lit(f"{LABELS[c]}:\n"), F.col(f"fields.{c}"))) for c in fields))
        specs.append(F.when(body != "", F.struct(F.lit(i).alias("ord"), F.lit(name).alias("content_type"), F.lit(label).alias("content_label"), body.alias("body"))))
    found = F.array_compact(F.array(*specs))
    whole = F.array(F.struct(F.lit(99).alias("ord"), F.lit("documento_completo").alias("content_type"), F.lit("Contenido completo").alias("content_label"), F.col("page_content").alias("body")))
    sections = records.withColumn("_s", F.explode(F.when(F.size(found) > 0, found).otherwise(whole))).select("*", "_s.*").drop("_s")
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    head = F.concat_ws("\n", F.lit(wording.banner), F.concat(wording.entity(F.col("code")), F.lit(": "), F.col("code")), F.concat(F.lit("Nombre: "), F.col("title")), line("Sección", "section"), line("Categoría", "category"), line("Estado en la fuente", "status"))
    pack = F.udf(partial(packed_sections, more=wording.headings), "array<struct<code:string,title:string,text:string>>")
    subs = F.transform("subprocedures", lambda x: F.struct(x["code"].alias("code"), x["title"].alias("title")))
    rows = sections.withColumn("_head", head).withColumn("_subs", subs)
    rows = rows.select("*", F.posexplode(pack("body", "_subs", "_head", F.col("content_type").isin(*LONG_FIELDS), F.lit(target), F.lit(most))).alias("_i", "_p"))
    rows = rows.withColumn("chunk_sequence", (F.col("_i") + 1).cast("int")).withColumn("raw_text", F.col("_p.text")).withColumn("subprocedure_code", F.col("_p.code")).withColumn("subprocedure_title", F.col("_p.title"))
    told = F.when(F.col("subprocedure_code").isNotNull(), F.concat(F.lit("Subprocedimiento: "), F.col("subprocedure_code"), F.when(F.coalesce("subprocedure_title", F.lit("")) != "", F.concat(F.lit(" - "), F.col("subprocedure_title"))).otherwise("")))
    rows = rows.withColumn("_head", F.concat_ws("\n", F.col("_head"), told, line("Tipo de contenido", "content_label")))
    content = F.concat_ws("\n\n", "_head", "raw_text")
    return rows.select(F.format_string("%s_%s_%03d", F.col("id"), slug("content_type"), F.col("chunk_sequence")).alias("id"), F.col("id").alias("parent_id"), "code", "title", "section", "category", "status", "content_type", "content_label", "subprocedure_code", "subprocedure_title", "chunk_sequence", token_count(content).alias("approx_tokens"), content.alias("page_content"), "raw_text", (F.col("ord") * 10_000 + F.col("chunk_sequence")).alias("seq"))
