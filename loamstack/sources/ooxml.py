"""Tables of .docx and first columns of .xlsx files, by the standard library, from Spark's binary files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_rows(data: bytes) -> list[dict]:
    """Rows of all top-level tables: table_index, row_index, cells (paragraphs joined by newlines; spanned columns repeat the text)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for t, table in enumerate(body.findall(f"{_W}tbl") if body is not None else ()):
        for r, row in enumerate(table.findall(f"{_W}tr")):
            cells = []
            for cell in row.findall(f"{_W}tc"):
                text = "\n".join("".join(x.text or "" if x.tag == f"{_W}t" else "\n" if x.tag == f"{_W}br" else " " if x.tag == f"{_W}tab" else "" for x in p.iter()) for p in cell.iter(f"{_W}p"))
                span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                cells += [text.strip()] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
            out.append({"table_index": t, "row_index": r, "cells": cells})
    return out


def xlsx_rows(data: bytes) -> list[dict]:
    """The first two columns of the first sheet: row (from 1), code, title."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        rows = ET.fromstring(z.read(first)).iter(f"{_S}row")
        out = []
        for i, row in enumerate(rows, start=1):
            got: dict[str, str | None] = {"A": None, "B": None}
            for c in row.findall(f"{_S}c"):
                name = re.match("[A-Z]+", c.get("r", "A"))[0]
                if name in got:
                    v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                    got[name] = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else None
            out.append({"row": int(row.get("r", i)), "code": got["A"], "title": got["B"]})
    return out


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, table_index, row_index, cells) of all files under the path; one file is read in one place."""
    parse = F.udf(docx_rows, "array<struct<table_index:int,row_index:int,cells:array<string>>>")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("sheet"), F.explode(parse("content")).alias("r")).select("sheet", "r.*")


def read_xlsx_index(spark: SparkSession, path: str) -> DataFrame:
    parse = F.udf(xlsx_rows, "array<struct<row:int,code:string,title:string>>")
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("sheet"), F.explode(parse("content")).alias("r")).select("sheet", "r.*")


def require_width(rows: DataFrame, width: int, cells: str = "cells") -> DataFrame:
    """Rows as they are; a row of another width raises when read."""
    ok = F.when(F.size(cells) == width, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a table row has another width: "), F.size(cells).cast("string"))))
    return rows.filter(ok)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
