"""Decisions read from official texts (M-08, M-10, E-06, F-03, F-04, F-05, P-09): gazette provisions and cabinet agreements.

The delivered texts stand for both sources: a text of the gazette or the cabinet is one decision, its first line the title, and
the body that publishes it, at its top level, the department that proposes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.functions import text
from fiscalspark.operators.measures import money
from fiscalspark.plans import anchors, metrics, model, resolve
from fiscalspark.session import salted_join
from fiscalspark.sources.tables import table

#: Source of the texts, by the name under which its volume is asked for.
SOURCES = {"boe": "boe_sumario", "cdm": "consejo_ministros"}
#: Fixed value: class of the agreements that let money be spent.
AUTHORISED = "autorizacion_gasto"


def departments(spark: SparkSession, d: str) -> DataFrame:
    """organo_id with the name of the entry of the second level that it is or stands under."""
    o = table(spark, d, "organo_canonico").select("organo_id", "nivel", "padre_id", "denominacion")
    top = o.where("nivel = 2").select(F.col("organo_id").alias("top"), F.col("denominacion").alias("ministerio"))
    return o.select("organo_id", F.when(F.col("nivel") == 2, F.col("organo_id")).otherwise(F.col("padre_id")).alias("top")).join(top, "top").groupBy("organo_id").agg(F.min("ministerio").alias("ministerio"))


def decisions(spark: SparkSession, d: str, source: str) -> DataFrame:
    """id, fecha, ejercicio, periodo, ministerio, titulo, tipo, importe and importe_confianza of the source's texts; null and blank
    texts are no decisions."""
    docs = table(spark, d, "documents").where((F.col("source") == SOURCES[source]) & F.col("text").rlike(r"\S")).select(F.col("doc_id").alias("id"), "fecha", "organo_id", "text")
    t = docs.withColumn("titulo", F.substring_index("text", "\n", 1))
    kind = text.gazette_class("titulo") if source == "boe" else text.cabinet_class("titulo")
    a = text.amount("text")
    rows = t.select("id", "fecha", F.year("fecha").alias("ejercicio"), F.date_format("fecha", "yyyy-MM").alias("periodo"), "organo_id", "titulo", kind.alias("tipo"), a.alias("a"))
    named = salted_join(rows, departments(spark, d), ["organo_id"], "left")
    return named.select("id", "fecha", "ejercicio", "periodo", "ministerio", "titulo", "tipo", F.col("a.importe").alias("importe"), F.col("a.confianza").alias("importe_confianza"))


def anchored(spark: SparkSession, d: str, source: str) -> DataFrame:
    """decisions with the section of their department (E-06)."""
    rows = decisions(spark, d, source)
    found = anchors.section_anchors(rows, anchors.sections_by_name(spark, d))
    found = found.select(F.col("ministerio").alias("_m"), F.col("ejercicio").alias("_e"), "seccion_cod", "anclaje_tipo", "anclaje_senal")
    return rows.join(F.broadcast(found), rows["ministerio"].eqNullSafe(found["_m"]) & rows["ejercicio"].eqNullSafe(found["_e"]), "left").drop("_m", "_e")


def departments_anchored(spark: SparkSession, d: str) -> DataFrame:
    """E-06: each department and year of both sources with its section, kind of anchor and signal."""
    both = decisions(spark, d, "boe").select("ministerio", "ejercicio").unionByName(decisions(spark, d, "cdm").select("ministerio", "ejercicio"))
    return anchors.section_anchors(both, anchors.sections_by_name(spark, d))


def view(source: str):
    """P-09: decisions with the name of their section in the year nearest to theirs (the later of two, J-04), null without year."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = anchored(spark, d, source).drop("titulo")
        named = model.services(spark, d).where("seccion_denominacion IS NOT NULL").groupBy("seccion_cod", F.col("ejercicio").alias("y")).agg(F.min("seccion_denominacion").alias("nombre"))
        asked = rows.where("seccion_cod IS NOT NULL").select("seccion_cod", "ejercicio").distinct()
        far = F.struct(F.abs(F.col("y") - F.col("ejercicio")).alias("d"), (-F.col("y")).alias("y"), "nombre")
        near = asked.join(named, "seccion_cod").groupBy("seccion_cod", "ejercicio").agg(F.min(far).alias("m")).select("seccion_cod", "ejercicio", F.col("m.nombre").alias("seccion_denominacion"))
        return rows.join(F.broadcast(near), ["seccion_cod", "ejercicio"], "left")

    return query


def volume(source: str, level: str = "seccion", year: int | None = None, period: str | None = None):
    """M-08: decisions by section or department and class: number, amounts of high and of medium trust, number without amount."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = anchored(spark, d, source).where(metrics.window_of(period, year))
        part = lambda c: F.coalesce(money(F.when(F.col("importe_confianza") == c, F.col("importe"))), F.lit(0.0))
        return rows.groupBy(F.col("seccion_cod" if level == "seccion" else "ministerio").alias("grupo"), "tipo").agg(F.count("*").alias("n"), part("alta").alias("importe_alta"), part("media").alias("importe_media"), F.count_if(F.col("importe_confianza") == "sin_importe").alias("n_sin_importe"))

    return query


def against_commitment(year: int = metrics.YEAR):
    """M-10: spending that the cabinet let in a year, in all and of high trust, against the awards of the year, by section; missing sides 0."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = anchored(spark, d, "cdm").where((F.col("ejercicio") == year) & (F.col("tipo") == AUTHORISED) & F.col("seccion_cod").isNotNull())
        a = rows.groupBy("seccion_cod").agg(money("importe").alias("autorizado_cdm"), money(F.when(F.col("importe_confianza") == "alta", F.col("importe")).otherwise(0.0)).alias("autorizado_cdm_alta"))
        c = model.contracts(spark, d).where((F.col("ejercicio") == year) & (F.col("anclaje_tipo") == "servicio")).groupBy("seccion_cod").agg(money("importe_adjudicacion").alias("adjudicado"))
        a, c = a.alias("a"), c.alias("c")
        j = a.join(c, F.col("a.seccion_cod").eqNullSafe(F.col("c.seccion_cod")), "full")
        zero = lambda x: F.coalesce(F.col(x), F.lit(0.0)).alias(x)
        return j.select(F.coalesce("a.seccion_cod", "c.seccion_cod").alias("seccion_cod"), zero("autorizado_cdm"), zero("autorizado_cdm_alta"), zero("adjudicado"))

    return query


def amounts(spark: SparkSession, d: str) -> DataFrame:
    """F-03: texts and amounts of both sources by trust."""
    rows = decisions(spark, d, "boe").unionByName(decisions(spark, d, "cdm"))
    return rows.groupBy("importe_confianza").agg(F.count("*").alias("n"), money("importe").alias("importe"))


QUERIES = {
    "e06_departamentos": departments_anchored, "f03_importes": amounts, "v05_disposiciones": view("boe"), "v06_acuerdos": view("cdm"), "m08_decisiones": volume("boe", "ministerio"), "m08_decisiones_boe": volume("boe"), "m08_decisiones_cdm": volume("cdm"),
    "m08_decisiones_cdm_ejercicio": volume("cdm", "ministerio", year=metrics.YEAR), "m08_decisiones_boe_periodo": volume("boe", "seccion", period=metrics.MONTH), "m10_decisiones_contratos": against_commitment(),
}

_m = metrics._money


def _classes(n: str, classes: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({n}, '{p}') THEN '{k}'" for k, p in classes) + " ELSE 'otro' END"


def _found(c: str) -> str:
    return ", ".join(f"regexp_extract({c}, '{p.replace('(?iu)', '(?i)')}', 1) AS f{i}" for i, (p, _) in enumerate(text.AMOUNTS))


def _decisions(source: str) -> str:
    classes = text.GAZETTE if source == "boe" else text.CABINET
    return f"""{source}_d AS (SELECT doc_id AS id, fecha, CAST(year(fecha) AS INT) AS ejercicio, strftime(fecha, '%Y-%m') AS periodo, organo_id, {resolve._normal("split_part(text, chr(10), 1)")} AS n, {_found("text")} FROM documents WHERE source = '{SOURCES[source]}' AND regexp_matches(text, '\\S')),
{source}_k AS (SELECT id, fecha, ejercicio, periodo, organo_id, {_classes("n", classes)} AS tipo, coalesce(nullif(f0, ''), nullif(f1, ''), nullif(f2, '')) AS f, CASE WHEN f0 <> '' OR f1 <> '' THEN 'alta' WHEN f2 <> '' THEN 'media' ELSE 'sin_importe' END AS importe_confianza FROM {source}_d),
{source}_n AS (SELECT k.*, dp.ministerio, TRY_CAST(replace(replace(f, '.', ''), ',', '.') AS DOUBLE) AS importe FROM {source}_k k LEFT JOIN dp USING (organo_id))"""


_DEP = "dp AS (SELECT o.organo_id, min(t.denominacion) AS ministerio FROM organo_canonico o JOIN organo_canonico t ON t.nivel = 2 AND t.organo_id = CASE WHEN o.nivel = 2 THEN o.organo_id ELSE o.padre_id END GROUP BY 1)"
_IX = f"ix AS (SELECT ejercicio AS y, {resolve._key('seccion_denominacion', 'ministerio')} AS k, min(seccion_cod) AS lo, max(seccion_cod) AS hi FROM sv WHERE seccion_denominacion IS NOT NULL AND seccion_cod IS NOT NULL AND {resolve._key('seccion_denominacion', 'ministerio')} <> '' GROUP BY 1, 2)"


def _sections(asked: str) -> str:
    return f"""aq AS (SELECT DISTINCT ministerio, ejercicio FROM ({asked})),
ay AS (SELECT *, {resolve._normal("ministerio")} AS n, {resolve._key("ministerio", "ministerio")} AS k, coalesce((SELECT max(y) FROM ix WHERE y <= aq.ejercicio), (SELECT min(y) FROM ix)) AS y FROM aq),
sa AS (SELECT ministerio, ejercicio, CASE WHEN n <> '' AND NOT regexp_matches(n, '{anchors.OUTSIDE}') AND lo = hi THEN lo END AS seccion_cod,
  CASE WHEN n = '' THEN 'sin_anclar' WHEN regexp_matches(n, '{anchors.OUTSIDE}') THEN 'fuera_perimetro' WHEN lo = hi THEN 'seccion' ELSE 'sin_anclar' END AS anclaje_tipo,
  CASE WHEN n = '' THEN 'sin_ministerio' WHEN regexp_matches(n, '{anchors.OUTSIDE}') THEN 'departamento_no_age' WHEN lo = hi THEN 'ministerio_denominacion' WHEN lo < hi THEN 'ministerio_ambiguo' ELSE 'ministerio_no_mapeable' END AS anclaje_senal FROM ay LEFT JOIN ix USING (y, k))"""


def _anchored(source: str) -> str:
    return f"{model.SERVICES}, {_DEP}, {_IX}, {_decisions(source)}, {_sections(f'SELECT ministerio, ejercicio FROM {source}_n')}, q AS (SELECT x.*, sa.seccion_cod, sa.anclaje_tipo, sa.anclaje_senal FROM {source}_n x LEFT JOIN sa ON sa.ministerio IS NOT DISTINCT FROM x.ministerio AND sa.ejercicio IS NOT DISTINCT FROM x.ejercicio)"


def _volume(source: str, grupo: str, keep: str = "true") -> str:
    return f"""WITH {_anchored(source)} SELECT {grupo} AS grupo, tipo, count(*) AS n, coalesce({_m("CASE WHEN importe_confianza = 'alta' THEN importe END")}, 0) AS importe_alta, coalesce({_m("CASE WHEN importe_confianza = 'media' THEN importe END")}, 0) AS importe_media,
  count(*) FILTER (WHERE importe_confianza = 'sin_importe') AS n_sin_importe FROM q WHERE {keep} GROUP BY 1, 2"""


def _view(source: str) -> str:
    return f"""WITH {_anchored(source)}, na AS (SELECT seccion_cod, ejercicio AS y, min(seccion_denominacion) AS nombre FROM sv WHERE seccion_denominacion IS NOT NULL GROUP BY 1, 2)
SELECT id, fecha, ejercicio, periodo, ministerio, tipo, importe, importe_confianza, seccion_cod, anclaje_tipo, anclaje_senal, CASE WHEN ejercicio IS NOT NULL THEN (SELECT nombre FROM na WHERE na.seccion_cod = q.seccion_cod ORDER BY abs(y - q.ejercicio), y DESC LIMIT 1) END AS seccion_denominacion FROM q"""


SQL = {
    "e06_departamentos": f"WITH {model.SERVICES}, {_DEP}, {_IX}, {_decisions('boe')}, {_decisions('cdm')}, {_sections('SELECT ministerio, ejercicio FROM boe_n UNION ALL SELECT ministerio, ejercicio FROM cdm_n')} SELECT * FROM sa",
    "f03_importes": f"WITH {_DEP}, {_decisions('boe')}, {_decisions('cdm')} SELECT importe_confianza, count(*) AS n, {_m('importe')} AS importe FROM (SELECT importe_confianza, importe FROM boe_n UNION ALL SELECT importe_confianza, importe FROM cdm_n) GROUP BY 1",
    "v05_disposiciones": _view("boe"),
    "v06_acuerdos": _view("cdm"),
    "m08_decisiones": _volume("boe", "ministerio"),
    "m08_decisiones_boe": _volume("boe", "seccion_cod"),
    "m08_decisiones_cdm": _volume("cdm", "seccion_cod"),
    "m08_decisiones_cdm_ejercicio": _volume("cdm", "ministerio", f"ejercicio = {metrics.YEAR}"),
    "m08_decisiones_boe_periodo": _volume("boe", "seccion_cod", f"periodo = '{metrics.MONTH}'"),
    "m10_decisiones_contratos": f"""WITH {_anchored("cdm")}, {model.CONTRACTS}, a AS (SELECT seccion_cod, {_m("importe")} AS autorizado_cdm, {_m("CASE WHEN importe_confianza = 'alta' THEN importe ELSE 0 END")} AS autorizado_cdm_alta FROM q WHERE ejercicio = {metrics.YEAR} AND tipo = '{AUTHORISED}' AND seccion_cod IS NOT NULL GROUP BY 1),
c AS (SELECT seccion_cod, {_m("importe_adjudicacion")} AS adjudicado FROM ct WHERE ejercicio = {metrics.YEAR} AND anclaje_tipo = 'servicio' GROUP BY 1)
SELECT coalesce(a.seccion_cod, c.seccion_cod) AS seccion_cod, coalesce(autorizado_cdm, 0) AS autorizado_cdm, coalesce(autorizado_cdm_alta, 0) AS autorizado_cdm_alta, coalesce(adjudicado, 0) AS adjudicado FROM a FULL JOIN c ON a.seccion_cod IS NOT DISTINCT FROM c.seccion_cod""",
}
