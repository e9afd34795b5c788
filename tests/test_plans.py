from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_operators import INDEX, cells

from loamstack import config
from loamstack.operators import sections
from loamstack.plans import catalogue, web_corpus

RAW = {
    "defaults": {"min_chars": 40, "min_words": 5, "max_words": 40, "overlap_words": 0},
    "global_exclude": ["noticia"],
    "sources": [{"source": "web", "domain": "h.pe", "prefixes": ["/guia"], "default_audience": "personas", "default_topic": "general"}],
    "classification": {"audience_rules": [{"label": "empresas", "patterns": ["empresa"]}], "topic_rules": [{"label": "ruc", "patterns": ["ruc"]}]},
}


def test_config():
    c = config.from_mapping(RAW, {"LOAMSTACK_RPS": "2.5"})
    assert c.defaults.requests_per_second == 2.5 and c.source("web").prefixes == ("/guia",) and len(c.selected()) == 1
    with pytest.raises(KeyError, match="there are web"):
        c.source("x")
    for bad in ({"defaults": {"min_words": 0}}, {"defaults": {"nope": 1}}, {"sources": [{"source": "a", "domain": "b", "default_audience": "nadie"}]}):
        with pytest.raises((ValueError, TypeError)):
            config.from_mapping(bad, {})


def test_web_corpus(rows):
    c = config.from_mapping(RAW, {})
    good = "<main><h1>Guía</h1><p>" + "bien dicho. " * 20 + "{}</p></main>"
    found = rows("source string, url string, lastmod string, seq int", [("web", u, None if i else "2024", i) for i, u in enumerate(["https://h.pe/guia/ruc", "https://h.pe/guia/RUC?b=1", "https://h.pe/guia/ruc/", "https://h.pe/guia/empresa", "https://h.pe/noticia", "https://h.pe/guia/x.pdf", "https://h.pe/guia/none", "https://h.pe/guia/short", "https://h.pe/guia/bad"])])
    manual = rows("source string, url string, seq int", [("web", "https://h.pe/guia/ruc#x", 100), ("web", "https://h.pe/guia/copy", 101)])
    decided = web_corpus.discovered(c, found, manual)
    assert decided.count() == 10
    snapshot = rows("url string, html string, status int, content_type string, error string", [("https://h.pe/guia/ruc", good.format("a"), 200, "text/html", None), ("https://h.pe/guia/RUC?b=1", good.format("b"), 200, None, None), ("https://h.pe/guia/empresa", good.format("c"), 200, "text/html", None), ("https://h.pe/guia/short", "<p>x</p>", 200, "text/html", ""), ("https://h.pe/guia/bad", None, 404, "text/html", None), ("https://h.pe/guia/copy", good.format("a"), 200, "text/html", None)])
    out = web_corpus.build(c, decided, snapshot)
    docs = {r.id: r for r in out.documents.collect()}
    assert set(docs) == {"web-guia-ruc", next(i for i in docs if i.startswith("web-guia-ruc-")), "web-guia-empresa"}
    assert (docs["web-guia-ruc"].topic, docs["web-guia-ruc"].audience, docs["web-guia-ruc"].updated_at, docs["web-guia-empresa"].audience, docs["web-guia-empresa"].topic) == ("ruc", "personas", "2024", "empresas", "general")
    assert sorted((r.url.rpartition("/")[2], r.reason) for r in out.rejected.collect()) == [("bad", "download_error"), ("copy", "duplicate"), ("none", "download_error"), ("noticia", "excluded_by_rule"), ("ruc", "duplicate"), ("short", "insufficient_text"), ("x.pdf", "pdf")]
    chunks = out.chunks.collect()
    assert {r.document_id for r in chunks} == set(docs) and all(r.id == f"{r.document_id}-{r.id[-3:]}" for r in chunks)
    assert ("reason", "duplicate", 2) in {tuple(r) for r in out.summary().collect()} and out.faqs.count() == 0


def test_catalogue_and_postprocess(rows, spark):
    table = [cells("1", "Alta de RUC\nFUNDAMENTO LEGAL: Ley 1", "1.1 Personas\nDNI vigente\n\n2.7 dice la ley\n\nREQUISITOS GENERALES\n\nCarta simple", "X"), cells("2", "Baja\nDecreto 5", "Carta"), cells("99", "?")]
    built = catalogue.build(rows("sheet string, row int, code string, title string", INDEX), rows("sheet string, table_index int, row_index int, cells array<string>", [("f", 0, i, c) for i, c in enumerate(table)]))
    chunks = {c.id: c for c in built.chunks.collect()}
    one = chunks["proc_1_requisitos_001"]
    assert one.subprocedure_code == "1.1" and one.subprocedure_title == "Personas" and "Subprocedimiento: 1.1 - Personas\nTipo de contenido: Requisitos" in one.page_content
    assert chunks["proc_1_requisitos_002"].raw_text == "REQUISITOS GENERALES\n\nCarta simple" or "REQUISITOS GENERALES" in chunks["proc_1_requisitos_002"].raw_text
    report = {r.measure: r.value for r in built.report().collect()}
    assert report["codes_missing"] == "1" and report["rows_unknown"] == "1" and report["result"] == "review"
    done = catalogue.postprocess(built.parents, built.chunks)
    assert [r.code for r in done.inactive.collect()] == ["1"] and {r.parent_id for r in done.active_chunks.collect()} == {"proc_2"} and {r.parent_id for r in done.inactive_chunks.collect()} == {"proc_1"}
    assert catalogue.preview(built.parents, 1).startswith("# Procedimiento 1")
    with pytest.raises(ValueError, match="no parents of"):
        catalogue.postprocess(built.parents.filter("code <> '1'"), built.chunks)
    heads = built.chunks.filter("parent_id = 'proc_2'").withColumn("raw_text", F.when(F.col("seq") == F.lit(1), "Requisitos generales:").otherwise(F.col("raw_text")))
    assert catalogue.postprocess(built.parents, heads).active_chunks.count() <= heads.count()


def test_sections():
    subs = [("1.1", "Alta"), ("01.2", "Cambio de datos")]
    text = "intro\n1.1. Alta\ncuerpo\n1.9 otro\nNOTA: algo\n18.09.2004"
    assert sections.sections(text, subs) == [(None, "intro"), ("1.1. Alta", "1.1. Alta\ncuerpo\n1.9 otro"), ("NOTA: algo", "NOTA: algo\n18.09.2004")]
    assert sections.named_sub("1.02 x", subs) == ("01.2", "Cambio de datos") and sections.named_sub("sobre cambio de DATOS hoy", subs)[0] == "01.2" and sections.named_sub("", subs) == (None, None)
    assert sections.clean("a\xa0\x07b\r\n\r\n\r\n\r\nﬁn ") == "a b\n\nfin"
