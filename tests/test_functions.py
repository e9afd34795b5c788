from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from loamstack import fixed
from loamstack.functions import flags, text


def column(spark, make, values):
    data = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in data.orderBy("i").select(make("v")).collect()]


def test_match_key_and_slug(spark):
    assert column(spark, text.match_key, ["  Ñandú,  çà! 12", "", None, "straße"]) == ["NANDU CA 12", "", None, "STRASSE"]
    assert column(spark, text.slug, ["Árbol de  Ñ", "", "¡¿", "a" * 90]) == ["arbol_de_n", "item", "item", "a" * 80]


@pytest.mark.parametrize(("raw", "code"), [("01", "1"), ("08-A", "8-A"), ("Servicio 01", "SERVICIO 1"), ("1.0", "1"), (" 007 .", "7"), ("N°3", "3"), ("N° 3", " 3"), ("abc", "ABC"), (None, ""), ("0", "0")])
def test_catalogue_code(spark, raw, code):
    assert column(spark, text.catalogue_code, [raw]) == [code]


def test_sub_codes(spark):
    assert column(spark, text.sub_code, ["01.02.3", "8-A.01"]) == ["1.2.3", "8-A.1"]
    got = column(spark, text.sub_procedure, ["01.2 - Alta de persona", "no code", "3 alone"])
    assert (got[0]["code"], got[0]["title"]) == ("1.2", "Alta de persona")
    assert got[1:] == [None, None]


def test_counts_follow_unicode(spark):
    assert column(spark, text.word_count, ["a b c d", "", None]) == [4, 0, 0]
    assert column(spark, text.token_count, ["¿Qué, año?", "Ñandú"]) == [5, 1]
    assert column(spark, text.token_estimate, ["", "one two three four five"]) == [1, 6]


def test_hashes(spark):
    assert column(spark, text.content_hash, ["  hola \n"]) == [hashlib.sha256(b"hola").hexdigest()]
    a, b = column(spark, text.fingerprint, ["Hola, Día", "HOLA dia!"])
    assert a == b


def test_tax_id(spark):
    def valid(n):
        rest = 11 - sum(int(d) * w for d, w in zip(n, fixed.TAX_ID_WEIGHTS, strict=False)) % 11
        return int(n[10]) == {10: 0, 11: 1}.get(rest, rest)

    numbers = [f"20{i * 7919 % 10**8:08d}{i % 10}" for i in range(60)]
    assert column(spark, text.tax_id_valid, numbers) == [valid(n) for n in numbers]
    assert column(spark, text.tax_id_valid, ["", None, "2010", "30" + "0" * 9, "20abc123456"]) == [False] * 5


def test_flags(spark):
    got = column(spark, flags.status, [None, " ", "Eliminado por ley", "Modificado a servicio prestado en exclusividad", "otro"])
    assert [(s["is_active"], s["status_type"], s["status_detail"]) for s in got] == [
        (True, "vigente_en_documento", None), (True, "vigente_en_documento", None), (False, "eliminado", "Eliminado por ley"),
        (False, "reemplazado_por_servicio", "Modificado a servicio prestado en exclusividad"), (True, "estado_no_clasificado", "otro"),
    ]
    assert column(spark, flags.heading_only, ["Requisitos  generales:", "DOCUMENTACIÓN - REQUISITOS ESPECÍFICOS", "Requisitos generales y más", None]) == [True, True, False, False]
    assert column(spark, flags.has_mark, ["x", "a X b", "ex", None]) == [True, True, False, False]
    assert column(spark, flags.is_question, ["¿Cómo se paga?", "Corto?", "No pregunta nada.", None]) == [True, False, False, False]


def test_column_header(spark):
    data = spark.createDataFrame([(["Número de orden", "Autoridad competente"],), (["x"],)], "c array<string>")
    assert [r[0] for r in data.select(flags.column_header("c", ("NUMERO DE ORDEN", "AUTORIDAD COMPETENTE"))).collect()] == [True, False]
    assert data.select(F.lit(1)).count() == 2
