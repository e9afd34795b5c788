from __future__ import annotations

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("ka lo mi ru te na so".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    passage, leak, first = say(60), say(40), say(300)
    docs = [(1, first), (2, first), (3, first.replace(first.split()[9], "other", 1)), (4, say(80) + " " + passage + " " + say(80)), (5, say(90) + " " + passage), (6, say(20) + " " + leak + " " + say(20)), (7, say(900) + " " + leak[:120] + " " + say(900)), (8, "12 34"), (9, None), (10, say(2500))]
    docs += [(i, say(rng.randint(30, 200))) for i in range(11, 60)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(d, t, "xx", "s", len(t or ""), "extra") for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(docs), passage, leak


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    at, text, passage, leak = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r for r in docs.collect()}
    clean = {1, 10, *range(11, 60)}
    assert set(seen["language_id"]) == set(text) - {8, 9}
    assert set(seen["simhash_dedup"]) == set(text) - {2, 3, 8, 9}
    cut = seen["substring_dedup"]
    assert set(cut) == set(seen["simhash_dedup"]) and passage not in cut[4].text and cut[4].n_chars == len(cut[4].text) and all(cut[i].text == text[i] for i in clean)
    last = seen["decontaminate"]
    assert 6 not in last and 7 in last and clean <= set(last) and leak[:100] not in last[7].text and all(last[i].text == text[i] for i in clean)
    assert {r.doc_id for r in docs.collect()} == set(last)


def test_run_equals_the_stages(spark, folder):
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder[0]).collect()} >= {1, 10}


def test_stages_take_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder[0]).count() == 0
