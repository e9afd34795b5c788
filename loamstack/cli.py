"""``python -m loamstack.cli catalogue|web ...``: the two corpus builds from files to files."""

from __future__ import annotations

import argparse

from . import config
from .operators import catalog
from .plans import catalogue, web_corpus
from .session import build_session
from .sources import jsonl, ooxml
from .sources.tables import named_cells, write_report


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loamstack", description=__doc__)
    top.add_argument("--master", help="left to spark-submit if not given")
    kinds = top.add_subparsers(dest="kind", required=True)
    c = kinds.add_parser("catalogue", help="index sheets and document tables to parents and chunks")
    c.add_argument("--index", required=True, help=".xlsx files (path or glob)")
    c.add_argument("--tables", required=True, help=".docx files (path or glob)")
    c.add_argument("--sheet", default="catalogue", help="name that joins the index and its tables")
    c.add_argument("--target-tokens", type=int, default=450)
    c.add_argument("--max-tokens", type=int, default=650)
    c.add_argument("--debug-rows", action="store_true")
    w = kinds.add_parser("web", help="discovered URLs and a page snapshot to documents, chunks and questions")
    w.add_argument("--config", required=True)
    w.add_argument("--urls", required=True, help="JSON Lines: source, url, lastmod, seq")
    w.add_argument("--snapshot", required=True, help="Parquet: url, html, status, content_type, error")
    w.add_argument("--source")
    w.add_argument("--max-pages", type=int)
    for p in (c, w):
        p.add_argument("--output", required=True)
    return top


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    a = _arguments().parse_args(argv)
    spark = build_session(master=a.master)
    at = a.output.rstrip("/")
    if a.kind == "catalogue":
        index = ooxml.read_xlsx_index(spark, a.index).withColumn("sheet", F.lit(a.sheet))
        rows = ooxml.require_width(ooxml.read_docx_tables(spark, a.tables).withColumn("sheet", F.lit(a.sheet)), len(catalog.COLUMNS))
        built = catalogue.build(index, rows, target=a.target_tokens, most=a.max_tokens)
        done = catalogue.postprocess(built.parents, built.chunks)
        for name, rows_out in (("entries", built.entries), ("parents", built.parents), ("active_parents", done.active), ("inactive_parents", done.inactive), ("active_chunks", done.active_chunks), ("inactive_chunks", done.inactive_chunks)):
            jsonl.write_jsonl(rows_out, f"{at}/{name}")
        write_report(built.report(), f"{at}/report")
        if a.debug_rows:
            jsonl.write_jsonl(named_cells(rows, catalog.COLUMNS), f"{at}/rows")
        return 0
    c = config.load(a.config)
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "url", "lastmod")] + [T.StructField("seq", T.LongType())])
    found = jsonl.read_strict(spark, a.urls, kind).filter(F.col("source").isin([s.source for s in c.selected(a.source)]))
    corpus = web_corpus.build(c, web_corpus.discovered(c, found), spark.read.parquet(a.snapshot), max_pages=a.max_pages)
    for name in ("documents", "chunks", "faqs", "rejected"):
        jsonl.write_jsonl(getattr(corpus, name), f"{at}/{name}")
    write_report(corpus.summary(), f"{at}/summary")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
