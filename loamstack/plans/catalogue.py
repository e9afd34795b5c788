"""The catalogue from start to end, and the post-processing of its chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import heading_only, status
from ..functions.text import token_estimate
from ..operators import audit, catalog, chunking


@dataclass
class Catalogue:
    entries: DataFrame
    rows: DataFrame
    parents: DataFrame
    chunks: DataFrame

    def report(self) -> DataFrame:
        """(measure, value): rows by state, coverage of the index, tokens of the chunks, and the verdict (``ok`` or ``review``)."""
        states = self.rows.groupBy(F.concat(F.lit("rows_"), F.col("state")).alias("measure")).agg(F.count("*").cast("string").alias("value"))
        coverage = audit.coverage(self.parents.select("code"), self.entries.select("code"), key="code").groupBy(F.concat(F.lit("codes_"), F.col("state")).alias("measure")).agg(F.count("*").cast("string").alias("value"))
        tokens = audit.token_report(self.chunks, text="page_content")
        long = tokens.select(F.explode(F.create_map(*[x for c in tokens.columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("measure", "value"))
        found = states.unionByName(coverage).unionByName(long)
        verdict = found.agg(F.when(F.count_if(F.col("measure").isin("codes_missing", "rows_unknown")) > 0, "review").otherwise("ok").alias("value")).select(F.lit("result").alias("measure"), "value")
        return found.unionByName(verdict)


def build(index_rows: DataFrame, table_rows: DataFrame, *, target: int = 450, most: int = 650, wording: catalog.Wording = catalog.PLAIN) -> Catalogue:
    """Index rows (sheet, row, code, title) and table rows (sheet, table_index, row_index, cells) into entries, parents and chunks."""
    if not 0 < target < most:
        raise ValueError("0 < target < most must hold")
    entries = catalog.entries(catalog.parse_index(index_rows))
    grouped = catalog.group_rows(table_rows, entries, wording=wording)
    parents = catalog.parents(grouped, entries, wording=wording)
    return Catalogue(entries, grouped, parents, catalog.chunk_parents(parents, target=target, most=most, wording=wording))


def merged_content(chunks: DataFrame, wording: catalog.Wording = catalog.PLAIN) -> DataFrame:
    """Chunks that took in a heading get their header again, in the order of the second format, and a new token estimate."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    optional = [line(label, c) for label, c in (("Sección", "section"), ("Categoría", "category"), ("Tipo de contenido", "content_label"), ("Subprocedimiento", "subprocedure_code"), ("Nombre del subprocedimiento", "subprocedure_title")) if c in chunks.columns]
    head = F.concat_ws("\n", F.lit(wording.banner), F.concat(F.lit(f"{wording.procedure}: "), F.coalesce("code", F.lit(""))), *([F.concat(F.lit("Nombre: "), F.coalesce("title", F.lit("")))] if "title" in chunks.columns else []), *optional)
    changed = F.col("merged_heading_id").isNotNull()
    out = chunks.withColumn("page_content", F.when(changed, F.concat_ws("\n\n", head, F.trim("raw_text"))).otherwise(F.col("page_content")))
    return out.withColumn("approx_tokens", F.when(changed, token_estimate("page_content")).otherwise(F.col("approx_tokens")))


@dataclass
class Processed:
    active: DataFrame
    inactive: DataFrame
    active_chunks: DataFrame
    inactive_chunks: DataFrame


def check(parents: DataFrame, chunks: DataFrame) -> None:
    """Raises if ids occur twice or chunks have no parent; the message names a few."""
    for what, bad in (("parent ids", audit.duplicate_ids(parents, "id")), ("chunk ids", audit.duplicate_ids(chunks, "id")), ("parents of", audit.orphans(chunks, parents, child_key="parent_id", parent_key="id").select("id"))):
        if found := [r[0] for r in bad.limit(5).collect()]:
            raise ValueError(f"{'no ' if what == 'parents of' else 'repeated '}{what}: {', '.join(map(str, found))}")


def postprocess(parents: DataFrame, chunks: DataFrame, wording: catalog.Wording = catalog.PLAIN) -> Processed:
    """Status of parents, headings merged into the chunks after them, sequences renewed, active and inactive rows apart."""
    check(parents, chunks)
    told = parents.withColumn("_s", status("status")).select("*", "_s.*").drop("_s")
    merged = chunking.merge_headings(chunks, heading_only("raw_text"), id_col="id", parent="parent_id", kind="content_type", order="seq", text="raw_text")
    renewed = chunking.resequence(merged_content(merged, wording))
    keys = {"child_key": "parent_id", "parent_key": "id"}
    return Processed(told.filter("is_active"), told.filter("NOT is_active"), audit.with_active_parents(renewed, told, F.col("is_active"), **keys), audit.without_active_parents(renewed, told, F.col("is_active"), **keys))


def preview(parents: DataFrame, n: int = 5) -> str:
    """The first n records in index order as Markdown: a limit that is the feature."""
    rows = parents.orderBy("source_row").limit(n).select("page_content").collect()
    return "\n\n---\n\n".join(r.page_content for r in rows)
