"""Declarative schema checks (Q-01): patterns, closed lists, nulls, lower bounds and unique keys, as counts of violations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """What a table's rows must be. matches and among let nulls pass; required does not."""

    required: tuple[str, ...] = ()
    matches: dict[str, str] = field(default_factory=dict)
    among: dict[str, tuple] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    strict: bool = False


#: Shapes of the codes.
PERIOD, TWO_DIGITS, PROGRAMME, ECONOMIC, PROVINCE = r"^\d{4}-(0[1-9]|1[0-2])$", r"^\d{2}$", r"^[0-9A-ZÑ]{4,5}$", r"^\d{1,3}$|^\d{5}$|^\d{7}$", r"^\d{2}$|^DT$|^NT$"
EXECUTION = Contract(
    required=("periodo", "seccion_cod", "servicio_cod", "programa_cod", "economica_cod"),
    matches={"periodo": PERIOD, "seccion_cod": TWO_DIGITS, "servicio_cod": TWO_DIGITS, "programa_cod": PROGRAMME, "economica_cod": ECONOMIC, "provincia_cod": PROVINCE},
)
UNIT = r"^[A-Z]{1,2}\d{7,8}$"
#: Kinds of gazette provisions and cabinet agreements, grades of trust in an amount, states of a unit.
PROVISION_KINDS = ("convocatoria_subvencion", "subvencion_directa", "credito_extraordinario", "suplemento_credito", "transferencia_credito", "modificacion_credito", "otro")
AGREEMENT_KINDS = ("autorizacion_gasto", "subvencion", "transferencia_credito", "credito_suplemento", "convenio", "norma", "personal", "otro")
TRUST, STATES = ("alta", "media", "sin_importe"), ("V", "E", "A", "T")
MONEY = {"importe": "double"}
GRANTS = Contract(required=("concesion_id",), matches={"periodo": PERIOD}, among={"beneficiario_tipo": ("fisica", "juridica")}, unique=("concesion_id",), types=MONEY | {"fecha_concesion": "date", "fecha_alta": "date", "tiene_proyecto": "boolean"})
CONTRACTS = Contract(required=("licitacion_id", "lote_id", "es_cabecera_expediente"), matches={"periodo": PERIOD, "organo_dir3_cod": UNIT}, unique=("licitacion_id", "lote_id"), types={"importe_adjudicacion": "double", "es_cabecera_expediente": "boolean", "fecha_adjudicacion": "date"})
PROVISIONS = Contract(required=("identificador", "tipo_disposicion", "importe_confianza"), matches={"periodo": PERIOD}, among={"tipo_disposicion": PROVISION_KINDS, "importe_confianza": TRUST}, unique=("identificador",), types=MONEY | {"fecha": "date"})
AGREEMENTS = Contract(required=("acuerdo_id", "tipo_acuerdo", "importe_confianza"), matches={"periodo": PERIOD, "acuerdo_id": r"^\d{4}-\d{2}-\d{2}#\d{3,}$"}, among={"tipo_acuerdo": AGREEMENT_KINDS, "importe_confianza": TRUST}, unique=("acuerdo_id",), types=MONEY | {"fecha": "date"})
SERVICES = Contract(required=("ejercicio", "seccion_cod", "servicio_cod", "servicio_denominacion"), matches={"seccion_cod": TWO_DIGITS, "servicio_cod": TWO_DIGITS}, at_least={"ejercicio": 2000}, unique=("ejercicio", "seccion_cod", "servicio_cod"), types={"ejercicio": "int"})
UNITS = Contract(required=("dir3_cod", "denominacion", "estado"), matches={"dir3_cod": UNIT, "dir3_padre_cod": UNIT}, among={"estado": STATES}, at_least={"nivel_jerarquico": 0}, unique=("dir3_cod", "fecha_inicio"), types={"nivel_jerarquico": "int", "fecha_inicio": "date"})
ADDENDA = Contract(required=("ejercicio", "seccion_cod", "servicio_cod", "match_tipo"), matches={"seccion_cod": TWO_DIGITS, "servicio_cod": TWO_DIGITS, "dir3_cod": UNIT}, types={"ejercicio": "int"})


def violations(df: DataFrame, c: Contract) -> DataFrame:
    """regla, columna and n of every rule of the contract that some rows break; one pass for the row rules, one aggregation for the key.

    A column of another type counts once, as does one that a strict contract does not name; rules on columns that are not there
    are left out, but for required ones.
    """
    spark, have = df.sparkSession, dict(df.dtypes)
    shape = [("tipo", x, 1) for x, t in c.types.items() if x in have and have[x] != t] + [("falta", x, 1) for x in c.required if x not in have]
    if c.strict:
        named = {*c.required, *c.matches, *c.among, *c.at_least, *c.unique, *c.types}
        shape += [("sobra", x, 1) for x in have if x not in named]
    rules: list[tuple[str, str, Column]] = [("requerida", x, F.col(x).isNull()) for x in c.required if x in have]
    rules += [("forma", x, ~F.col(x).rlike(p)) for x, p in c.matches.items() if x in df.columns]
    rules += [("lista", x, ~F.col(x).isin(*v)) for x, v in c.among.items() if x in df.columns]
    rules += [("minimo", x, F.col(x) < v) for x, v in c.at_least.items() if x in df.columns]
    counts = df.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, _, bad) in enumerate(rules)]) if rules else None
    parts = []
    if counts is not None:
        each = F.array(*[F.struct(F.lit(r).alias("regla"), F.lit(x).alias("columna"), F.col(f"r{i}").alias("n")) for i, (r, x, _) in enumerate(rules)])
        parts.append(counts.select(F.explode(each).alias("e")).select("e.*").where("n > 0"))
    if shape:
        parts.append(spark.createDataFrame(shape, "regla string, columna string, n long"))
    if c.unique and all(x in have for x in c.unique):
        twice = df.groupBy(*c.unique).count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
        parts.append(twice.select(F.lit("unica").alias("regla"), F.lit(",".join(c.unique)).alias("columna"), "n"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "regla string, columna string, n long")
