"""Joined views (P-09, J-01 to J-04, J-19): facts with the names of their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.operators.measures import ratio
from fiscalspark.plans import model

SERVICE = ["ejercicio", "seccion_cod", "servicio_cod"]


def names_of(spark: SparkSession, d: str) -> DataFrame:
    return model.services(spark, d).select(*SERVICE, "seccion_denominacion", "servicio_denominacion")


def execution_view(spark: SparkSession, d: str) -> DataFrame:
    """v_ejecucion: execution of the known services, with names, chapter and degree as a fraction (J-01)."""
    e = model.execution(spark, d).select("periodo", *SERVICE, "programa_cod", "economica_cod", "provincia_cod", "credito_definitivo", "orn")
    return e.join(names_of(spark, d), SERVICE).withColumn("capitulo", F.substring("economica_cod", 1, 1)).withColumn("pct_ejecucion", F.round(ratio("orn", "credito_definitivo"), 6))


def current_execution(spark: SparkSession, d: str) -> DataFrame:
    """v_ejecucion_vigente: of each year the last month (J-03), as a window maximum instead of a self-join, by section."""
    e = model.execution(spark, d).select("ejercicio", "periodo", "seccion_cod", "orn")
    last = F.max("periodo").over(Window.partitionBy("ejercicio"))
    s = e.groupBy("ejercicio", "periodo", "seccion_cod").agg(F.sum(F.col("orn").cast("decimal(18,2)")).cast("double").alias("orn"))
    return s.withColumn("ultimo", last).where("periodo = ultimo").drop("ultimo")


def contracts_view(spark: SparkSession, d: str) -> DataFrame:
    """v_contratos: contracts with the names of their service, kept without anchor (J-02)."""
    c = model.contracts(spark, d).select("licitacion_id", "lote_id", *SERVICE, "anclaje_tipo", "importe_adjudicacion")
    return c.join(names_of(spark, d), SERVICE, "left")


def grants_view(spark: SparkSession, d: str) -> DataFrame:
    """v_subvenciones: grants with the names of their service, kept without anchor (J-02)."""
    g = model.grants(spark, d).select("concesion_id", *SERVICE, "anclaje_tipo", "importe")
    return g.join(names_of(spark, d), SERVICE, "left")


def nearest_year_names(spark: SparkSession, d: str) -> DataFrame:
    """J-04: name of a section in the year nearest to that of the grant (later of two), by grants of each year and section."""
    named = model.services(spark, d).where("seccion_denominacion IS NOT NULL").groupBy("seccion_cod", F.col("ejercicio").alias("y")).agg(F.min("seccion_denominacion").alias("nombre"))
    asked = model.grants(spark, d).where("seccion_cod IS NOT NULL").groupBy("ejercicio", "seccion_cod").agg(F.count("*").alias("n"))
    far = F.struct(F.abs(F.col("y") - F.col("ejercicio")).alias("d"), (-F.col("y")).alias("y"), "nombre")
    near = asked.join(named, "seccion_cod").groupBy("ejercicio", "seccion_cod").agg(F.min(far).alias("m"))
    return asked.join(near, ["ejercicio", "seccion_cod"], "left").select("ejercicio", "seccion_cod", "n", F.col("m.nombre").alias("nombre"))


def effective_year_names(spark: SparkSession, d: str) -> DataFrame:
    """J-19: name of a section in the last year up to the asked one, else in the first year, for every year of contracts."""
    named = model.services(spark, d).where("seccion_denominacion IS NOT NULL").groupBy("seccion_cod", F.col("ejercicio").alias("y")).agg(F.min("seccion_denominacion").alias("nombre"))
    asked = model.contracts(spark, d).where("seccion_cod IS NOT NULL").select("ejercicio", "seccion_cod").distinct()
    past = F.col("y") <= F.col("ejercicio")
    best = F.max(F.struct(past.alias("p"), F.when(past, F.col("y")).otherwise(-F.col("y")).alias("o"), "nombre"))
    return asked.join(named, "seccion_cod").groupBy("ejercicio", "seccion_cod").agg(best.alias("b")).select("ejercicio", "seccion_cod", F.col("b.nombre").alias("nombre"))


QUERIES = {"v01_ejecucion": execution_view, "v02_vigente": current_execution, "v03_contratos": contracts_view, "v04_subvenciones": grants_view, "j04_nombre_cercano": nearest_year_names, "j19_nombre_vigente": effective_year_names}

EXECUTION_VIEW = f"""{model.EXECUTION}, {model.SERVICES}, vej AS (SELECT ej.periodo, ej.ejercicio, ej.seccion_cod, ej.servicio_cod, programa_cod, economica_cod, provincia_cod, credito_definitivo, orn, seccion_denominacion, servicio_denominacion,
  left(economica_cod, 1) AS capitulo, round(orn / nullif(credito_definitivo, 0), 6) AS pct_ejecucion FROM ej JOIN sv USING (ejercicio, seccion_cod, servicio_cod))"""
_NAMED = f"{model.SERVICES}, na AS (SELECT seccion_cod, ejercicio AS y, min(seccion_denominacion) AS nombre FROM sv WHERE seccion_denominacion IS NOT NULL GROUP BY 1, 2)"
SQL = {
    "v01_ejecucion": f"WITH {EXECUTION_VIEW} SELECT * FROM vej",
    "v02_vigente": f"WITH {model.EXECUTION} SELECT ejercicio, periodo, seccion_cod, CAST(sum(CAST(orn AS DECIMAL(18,2))) AS DOUBLE) AS orn FROM ej JOIN (SELECT ejercicio, max(periodo) AS periodo FROM ej GROUP BY 1) USING (ejercicio, periodo) GROUP BY 1, 2, 3",
    "v03_contratos": f"WITH {model.CONTRACTS}, {model.SERVICES} SELECT licitacion_id, lote_id, ejercicio, seccion_cod, servicio_cod, anclaje_tipo, importe_adjudicacion, seccion_denominacion, servicio_denominacion FROM ct LEFT JOIN sv USING (ejercicio, seccion_cod, servicio_cod)",
    "v04_subvenciones": f"WITH {model.GRANTS}, {model.SERVICES} SELECT concesion_id, ejercicio, seccion_cod, servicio_cod, anclaje_tipo, importe, seccion_denominacion, servicio_denominacion FROM sb LEFT JOIN sv USING (ejercicio, seccion_cod, servicio_cod)",
    "j04_nombre_cercano": f"""WITH {model.GRANTS}, {_NAMED}, a AS (SELECT ejercicio, seccion_cod, count(*) AS n FROM sb WHERE seccion_cod IS NOT NULL GROUP BY 1, 2)
SELECT a.*, (SELECT nombre FROM na WHERE na.seccion_cod = a.seccion_cod ORDER BY abs(y - a.ejercicio), y DESC LIMIT 1) AS nombre FROM a""",
    "j19_nombre_vigente": f"""WITH {model.CONTRACTS}, {_NAMED}, a AS (SELECT DISTINCT ejercicio, seccion_cod FROM ct WHERE seccion_cod IS NOT NULL)
SELECT a.ejercicio, a.seccion_cod, nombre FROM a JOIN na ON na.seccion_cod = a.seccion_cod
QUALIFY row_number() OVER (PARTITION BY a.ejercicio, a.seccion_cod ORDER BY y <= a.ejercicio DESC, CASE WHEN y <= a.ejercicio THEN -y ELSE y END) = 1""",
}
