from __future__ import annotations

import gzip
import io
import zipfile

import pytest
from pyspark.sql import types as T

from loamstack.sources import jsonl, ooxml, sitemaps
from loamstack.streaming import session

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "a", "n": 1}\n\n{"id": "b"}\n')
    bad.write_text('{"id": "a"}\n[1]\n{broken\n')
    assert sorted(tuple(r) for r in jsonl.read_strict(spark, str(good), SCHEMA).collect()) == [("a", 1), ("b", None)]
    with pytest.raises(jsonl.BadLines) as e:
        jsonl.read_strict(spark, str(bad), SCHEMA)
    assert len(e.value.lines) == 2
    assert jsonl.read_lenient(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert jsonl.read_many(spark, [str(good), str(tmp_path / "none")], SCHEMA).count() == 2
    (tmp_path / "bad.jsonl").write_text("not json\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        jsonl.read_many(spark, [str(good), str(tmp_path / "bad.jsonl")], SCHEMA).collect()
    jsonl.write_jsonl(jsonl.read_strict(spark, str(good), SCHEMA), str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert '{"id":"b"}' in lines
    jsonl.write_csv(jsonl.read_strict(spark, str(good), SCHEMA), str(tmp_path / "csv"))
    assert any('"id","n"' in p.read_text() for p in (tmp_path / "csv").glob("part-*"))


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_ooxml(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t, span="": f"<w:tc><w:tcPr>{span}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": f"<w:document {w}><w:body><w:tbl><w:tr>{cell('a')}{cell('b', '<w:gridSpan w:val=\"2\"/>')}</w:tr></w:tbl></w:body></w:document>"}))
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Título</t></is></c></row><row r="3"><c r="A3"><v>1.0</v></c></row></sheetData></worksheet>'
    (tmp_path / "i.xlsx").write_bytes(zipped({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {s}><si><t>01</t></si></sst>"}))
    tables = ooxml.read_docx_tables(spark, str(tmp_path / "a.docx"))
    assert [r.cells for r in tables.collect()] == [["a", "b", "b"]]
    assert ooxml.require_width(tables, 3).count() == 1
    with pytest.raises(Exception, match="another width"):
        ooxml.require_width(tables, 14).collect()
    assert [(r.row, r.code, r.title) for r in ooxml.read_xlsx_index(spark, str(tmp_path / "i.xlsx")).collect()] == [(1, "01", "Título"), (3, "1.0", None)]
    assert len(ooxml.digests(spark, str(tmp_path / "a.docx")).first().sha256) == 64


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}><sitemap><loc> u/1 </loc></sitemap><sitemap><loc>u/0</loc></sitemap></sitemapindex>".encode()
    pages = gzip.compress(f"<urlset {ns}><url><loc>p/1</loc><lastmod>2024</lastmod></url><url><loc>p/1</loc></url><url><loc></loc></url></urlset>".encode())
    rss = b"<rss><channel><item><link>p/2</link><pubDate>hoy</pubDate></item></channel></rss>"
    files = spark.createDataFrame([("u/0", bytearray(index)), ("u/1", bytearray(pages)), ("u/2", bytearray(rss)), ("u/3", bytearray(b"<no"))], "url string, content binary")
    found = {r.loc: (r.depth, r.from_sitemap) for r in sitemaps.discover(files, spark.createDataFrame([("u/0",), ("u/2",), ("u/3",)], "url string")).collect()}
    assert found == {"p/1": (1, "u/1"), "p/2": (0, "u/2")}
    assert spark.createDataFrame([("https://h/x/sitemap.xml",)], "u string").select(sitemaps.rss_url("u")).first()[0] == "https://h/x/rss.xml"


def test_session_stream_and_batch_twin(spark, tmp_path):
    turns = [(1, t, "user", f"hola {t}") for t in range(12)] + [(2, 0, "user", "mi clave sol es x"), (2, 1, "user", "/ruc"), (2, 2, "user", "20100362598"), (2, 3, "user", "gracias"), (2, 4, "user", None), (2, 5, "user", "/reiniciar")]
    data = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {(r.conv_id, r.turn): r for r in session.run_stream(spark, str(tmp_path / "in"), data.schema, str(tmp_path / "check"), "session_rows").collect()}
    assert len(got) == len(turns)
    assert [got[1, t].stored_messages for t in (0, 7, 11)] == [1, 8, 8] and got[1, 11].prompt_messages == 4
    assert [got[2, t].action for t in range(6)] == ["blocked", "await", "tax_id", "message", "message", "reset"]
    assert got[2, 0].stored_messages == 0 and got[2, 2].tax_id == "20100362598"
    twin = {r.turn: (r.prompt_messages, r.stored_messages) for r in session.histories(data.filter("conv_id = 1")).collect()}
    assert twin == {t: (got[1, t].prompt_messages, got[1, t].stored_messages) for t in range(12)}
