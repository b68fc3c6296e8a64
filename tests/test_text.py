from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fiscalspark.functions import text


def one(spark, c, *values):
    schema = ", ".join(f"v{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(c.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("D.G. de Tráfico", "direccion general de trafico"), ("  Señal—y  ÑANDÚ ", "senal y nandu"), (None, ""), ("", ""), ("S. de E. de Cultura", "secretaria de estado de cultura"), ("Direccion Gral. X", "direccion general x")])
def test_normal(spark, raw, want):
    assert one(spark, text.normal("v0"), raw) == want


def test_token_key(spark):
    assert one(spark, text.token_key("v0"), "Obras de la Cultura y Obras") == "cultura obras"


@pytest.mark.parametrize(
    ("raw", "amount", "trust"),
    [
        ("por un importe total de 1.234.567,89 euros", 1234567.89, "alta"),
        ("Valor estimado del contrato: 21.526.792,10 euros", 21526792.10, "alta"),
        ("según tabla (1.000,00 €)", 1000.0, "alta"),
        ("Primer premio: 3.000 euros", 3000.0, "media"),
        ("un millón de euros", None, "sin_importe"),
        ("en 2026", None, "sin_importe"),
        ("300 dólares", None, "sin_importe"),
        ("", None, "sin_importe"),
        (None, None, "sin_importe"),
    ],
)
def test_amount(spark, raw, amount, trust):
    got = one(spark, text.amount("v0"), raw)
    assert (got.importe, got.confianza) == (amount, trust)


@pytest.mark.parametrize(("raw", "want"), [("Crédito extraordinario y suplemento de crédito", "credito_extraordinario"), ("Concesión directa de una subvención", "subvencion_directa"), ("Extracto de la Orden", "convocatoria_subvencion"), ("Generación de crédito", "modificacion_credito"), ("Nombramiento", "otro"), (None, "otro")])
def test_gazette_class(spark, raw, want):
    assert one(spark, text.gazette_class("v0"), raw) == want


def test_official_type_is_a_call(spark):
    assert one(spark, text.gazette_class("v0", F.col("v1")), "Resolución", "63") == "convocatoria_subvencion"
    assert one(spark, text.gazette_class("v0", F.col("v1")), "Transferencia de crédito", "63") == "transferencia_credito"


@pytest.mark.parametrize(("raw", "want"), [("Convenio con la UE", "convenio"), ("REAL DECRETO por el que", "norma"), ("ACUERDO por el que se autoriza la celebración", "autorizacion_gasto"), ("Informe", "otro")])
def test_cabinet_class(spark, raw, want):
    assert one(spark, text.cabinet_class("v0"), raw) == want


@pytest.mark.parametrize(("raw", "want"), [("A1234567B ACME SA", ("A1234567B", "ACME SA", "juridica")), ("***1234** PEPE", ("***1234**", "PEPE", "fisica")), ("12345678Z ANA", ("12345678Z", "ANA", "fisica")), ("ACME SA", (None, "ACME SA", None)), ("  ", (None, None, None)), (None, (None, None, None))])
def test_beneficiary(spark, raw, want):
    assert tuple(one(spark, text.beneficiary("v0"), raw)) == want


def test_organic_level(spark):
    df = spark.createDataFrame([("Ministerio de X", 1), ("Subdirección General", 3), ("Cosa", 1), ("D.G. de Y", 2)], "n string, d int")
    assert [tuple(r.x) for r in df.select(text.organic_level("n", "d").alias("x")).collect()] == [("MINISTERIO", "denominacion"), ("OTRO", "sin_senal"), ("MINISTERIO", "profundidad"), ("DIRECCION_GENERAL", "denominacion")]
