"""Canonical frames over the delivered tables, and the same as SQL, so that each query and its SQL start from one definition.

Delivered rows come repeated, late and with codes in several spellings. A canonical frame has one row per key, the one
captured last, codes as two digits, and the budget year taken from the period, which unlike the year is never mistyped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.functions import codes
from fiscalspark.operators.latest import latest_by
from fiscalspark.sources.tables import table


def two(c: str) -> Column:
    return F.lpad(codes.two_digits(c).cast("string"), 2, "0")


def execution(spark: SparkSession, d: str) -> DataFrame:
    """Budget execution, year to date: one row per (period, source, section, service, programme, economic code, province)."""
    rows = table(spark, d, "fact_ejecucion").select(
        "periodo", "fuente_cod", F.substring("periodo", 1, 4).cast("int").alias("ejercicio"), two("seccion_cod").alias("seccion_cod"), two("servicio_cod").alias("servicio_cod"), "programa_cod", "economica_cod",
        F.coalesce("provincia_cod", F.lit("NT")).alias("provincia_cod"), "aplicacion_denominacion", "credito_inicial", "credito_definitivo", "modificaciones", "orn", "pagos", "cobertura", "fecha_captura", "registro_id",
    )
    return latest_by(rows, ["periodo", "fuente_cod", "seccion_cod", "servicio_cod", "programa_cod", "economica_cod", "provincia_cod"], ["fecha_captura", "registro_id"])


def contracts(spark: SparkSession, d: str) -> DataFrame:
    """Contracts: one row per (tender, lot)."""
    rows = table(spark, d, "fact_contratos").select(
        "licitacion_id", "lote_id", "periodo", F.substring("periodo", 1, 4).cast("int").alias("ejercicio"), "es_cabecera_expediente", two("seccion_cod").alias("seccion_cod"), two("servicio_cod").alias("servicio_cod"), codes.dir3("anclaje_dir3_cod").alias("anclaje_dir3_cod"),
        "anclaje_tipo", "estado_cod", "organo_denominacion", "presupuesto_sin_iva", "importe_adjudicacion", "adjudicatario_id", "fecha_adjudicacion", "fecha_actualizacion", "fecha_captura",
    )
    return latest_by(rows, ["licitacion_id", "lote_id"], ["fecha_captura", "fecha_actualizacion"])


def grants(spark: SparkSession, d: str) -> DataFrame:
    """Grants: one row per grant, as republished last."""
    rows = table(spark, d, "fact_subvenciones").select(
        "concesion_id", "periodo", F.substring("periodo", 1, 4).cast("int").alias("ejercicio"), two("seccion_cod").alias("seccion_cod"), two("servicio_cod").alias("servicio_cod"), codes.dir3("anclaje_dir3_cod").alias("anclaje_dir3_cod"),
        "anclaje_tipo", "nivel1", "importe", "beneficiario_tipo", "fecha_concesion", "fecha_alta", "fecha_captura",
    )
    return latest_by(rows, ["concesion_id"], ["fecha_captura", "importe"])


def services(spark: SparkSession, d: str) -> DataFrame:
    """Sections and services by year: the row captured last of each key, names as they are there."""
    rows = table(spark, d, "dim_seccion_servicio").select("ejercicio", two("seccion_cod").alias("seccion_cod"), two("servicio_cod").alias("servicio_cod"), "presupuesto", "seccion_denominacion", "servicio_denominacion", "origen", "fecha_captura", "fecha_baja")
    return latest_by(rows, ["ejercicio", "seccion_cod", "servicio_cod"], ["fecha_captura", "servicio_denominacion", "seccion_denominacion"])


def units(spark: SparkSession, d: str) -> DataFrame:
    """Unit versions: the delivery captured last of each (unit, start)."""
    rows = table(spark, d, "dim_organica").select(codes.dir3("dir3_cod").alias("dir3_cod"), "denominacion", codes.dir3("dir3_padre_cod").alias("dir3_padre_cod"), codes.dir3("ministerio_dir3_cod").alias("ministerio_dir3_cod"), "ministerio_denominacion", "nivel_jerarquico", "nivel_organico", "tipo_entidad", "estado", "fecha_inicio", "fecha_fin", "localidad", "fecha_captura", "version_id")
    return latest_by(rows, ["dir3_cod", "fecha_inicio"], ["fecha_captura", "version_id"])


def bridge(spark: SparkSession, d: str) -> DataFrame:
    """Solved rows of the crosswalk: (year, section, service, unit), each once."""
    rows = table(spark, d, "crosswalk_servicio_dir3").where("dir3_cod IS NOT NULL")
    return rows.select("ejercicio", two("seccion_cod").alias("seccion_cod"), two("servicio_cod").alias("servicio_cod"), codes.dir3("dir3_cod").alias("dir3_cod")).distinct()


def _two(c: str) -> str:
    return f"lpad(CAST(TRY_CAST(trim({c}) AS INT) AS VARCHAR), 2, '0')"


def _latest(keys: str, order: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


EXECUTION = f"""ej AS (SELECT periodo, fuente_cod, CAST(left(periodo, 4) AS INT) AS ejercicio, {_two("seccion_cod")} AS seccion_cod, {_two("servicio_cod")} AS servicio_cod,
  programa_cod, economica_cod, coalesce(provincia_cod, 'NT') AS provincia_cod, aplicacion_denominacion, credito_inicial, credito_definitivo, modificaciones, orn, pagos, cobertura, fecha_captura
  FROM fact_ejecucion {_latest(f"periodo, fuente_cod, {_two('fact_ejecucion.seccion_cod')}, {_two('fact_ejecucion.servicio_cod')}, programa_cod, economica_cod, coalesce(fact_ejecucion.provincia_cod, 'NT')", "fecha_captura DESC, registro_id DESC")})"""
CONTRACTS = f"""ct AS (SELECT licitacion_id, lote_id, periodo, CAST(left(periodo, 4) AS INT) AS ejercicio, es_cabecera_expediente, {_two("seccion_cod")} AS seccion_cod, {_two("servicio_cod")} AS servicio_cod,
  upper(trim(anclaje_dir3_cod)) AS anclaje_dir3_cod, anclaje_tipo, estado_cod, organo_denominacion, presupuesto_sin_iva, importe_adjudicacion, adjudicatario_id, fecha_adjudicacion, fecha_actualizacion, fecha_captura
  FROM fact_contratos {_latest("licitacion_id, lote_id", "fecha_captura DESC, fecha_actualizacion DESC NULLS LAST")})"""
GRANTS = f"""sb AS (SELECT concesion_id, periodo, CAST(left(periodo, 4) AS INT) AS ejercicio, {_two("seccion_cod")} AS seccion_cod, {_two("servicio_cod")} AS servicio_cod,
  upper(trim(anclaje_dir3_cod)) AS anclaje_dir3_cod, anclaje_tipo, nivel1, importe, beneficiario_tipo, fecha_concesion, fecha_alta, fecha_captura
  FROM fact_subvenciones {_latest("concesion_id", "fecha_captura DESC, importe DESC NULLS LAST")})"""
SERVICES = f"""sv AS (SELECT ejercicio, {_two("seccion_cod")} AS seccion_cod, {_two("servicio_cod")} AS servicio_cod, presupuesto, seccion_denominacion, servicio_denominacion, origen, fecha_captura, fecha_baja
  FROM dim_seccion_servicio {_latest(f"ejercicio, {_two('dim_seccion_servicio.seccion_cod')}, {_two('dim_seccion_servicio.servicio_cod')}", "fecha_captura DESC, servicio_denominacion DESC NULLS LAST, seccion_denominacion DESC NULLS LAST")})"""
UNITS = f"""un AS (SELECT upper(trim(dir3_cod)) AS dir3_cod, denominacion, nullif(upper(trim(dir3_padre_cod)), '') AS dir3_padre_cod, nullif(upper(trim(ministerio_dir3_cod)), '') AS ministerio_dir3_cod, ministerio_denominacion, nivel_jerarquico, nivel_organico, tipo_entidad, estado, fecha_inicio, fecha_fin, localidad, fecha_captura, version_id
  FROM dim_organica {_latest("upper(trim(dim_organica.dir3_cod)), fecha_inicio", "fecha_captura DESC, version_id DESC")})"""
BRIDGE = f"""br AS (SELECT DISTINCT ejercicio, {_two("seccion_cod")} AS seccion_cod, {_two("servicio_cod")} AS servicio_cod, upper(trim(dir3_cod)) AS dir3_cod FROM crosswalk_servicio_dir3 WHERE dir3_cod IS NOT NULL)"""
