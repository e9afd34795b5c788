from __future__ import annotations

import json

from pyspark.sql import functions as F

from loamstack import cli
from loamstack.functions.unicode import cleaned, local_timestamp
from loamstack.sources import tables


def test_unicode(spark):
    data = spark.createDataFrame([("ﬁn\r\n\r\n\r\n\r\n a\tb\x07 ", "2024-01-02 03:04:05"), (None, None)], "t string, m string")
    got = data.select(cleaned("t").alias("c"), local_timestamp(F.col("m").cast("timestamp")).alias("l")).collect()
    assert tuple(got[0]) == ("fin\n\na b", "2024-01-01T22:04:05-05:00") and (got[1].c or "") == ""


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", "texto", [1.0], {"x": "1", "y": None})], "id string, page_content string, embedding array<double>, metadata map<string,string>")
    for _ in range(2):
        tables.rebuild_collection(rows, str(tmp_path / "v"))
    got = spark.read.parquet(str(tmp_path / "v")).collect()
    assert len(got) == 1 and got[0].metadata == {"x": "1"}
    assert tables.named_cells(spark.createDataFrame([(1, ["p", "q"])], "n int, cells array<string>"), ("a", "b", "c")).first().asDict() == {"n": 1, "a": "p", "b": "q", "c": None}


def test_web_command(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("defaults: {min_chars: 20, min_words: 2, max_words: 50}\nsources:\n  - {source: web, domain: h.pe, prefixes: [/guia]}\n")
    (tmp_path / "u.jsonl").write_text("\n".join(json.dumps({"source": "web", "url": f"https://h.pe/{x}", "seq": i}) for i, x in enumerate(["guia/a", "otro"])))
    spark.createDataFrame([("https://h.pe/guia/a", "<main><h1>A</h1><p>" + "bien dicho. " * 20 + "</p></main>", 200, "text/html", None)], "url string, html string, status int, content_type string, error string").write.parquet(str(tmp_path / "s"))
    assert cli.main(["web", "--config", str(tmp_path / "c.yaml"), "--urls", str(tmp_path / "u.jsonl"), "--snapshot", str(tmp_path / "s"), "--output", str(tmp_path / "out")]) == 0
    assert [r.id for r in spark.read.json(str(tmp_path / "out/documents")).collect()] == ["web-guia-a"]
    assert [(r.url, r.reason) for r in spark.read.json(str(tmp_path / "out/rejected")).collect()] == [("https://h.pe/otro", "excluded_by_rule")]
