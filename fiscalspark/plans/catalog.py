"""Structure, catalogues, freshness and health of the warehouse (G-01 to G-06), dimension loads and windows over the facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark import ops
from fiscalspark.functions import codes
from fiscalspark.operators.latest import latest_block
from fiscalspark.operators.measures import money, ratio
from fiscalspark.plans import metrics, model
from fiscalspark.sources.tables import table


def years(spark: SparkSession, d: str) -> DataFrame:
    """G-01: years with execution."""
    return model.execution(spark, d).select("ejercicio").distinct()


def sections(spark: SparkSession, d: str) -> DataFrame:
    """G-02: sections of each year with their number of services."""
    return model.services(spark, d).groupBy("ejercicio", "seccion_cod").agg(F.max("seccion_denominacion").alias("seccion_denominacion"), F.countDistinct("servicio_cod").alias("n_servicios"))


def services(spark: SparkSession, d: str) -> DataFrame:
    """G-03: services of each year with the unit of the crosswalk year nearest to the newest, and whether that is approximate."""
    newest = model.bridge(spark, d).agg(F.max("ejercicio").alias("cw"))
    lead = metrics.leading_unit(spark, d).join(F.broadcast(newest.withColumnRenamed("cw", "ejercicio")), "ejercicio").select("seccion_cod", "servicio_cod", "dir3_cod", F.col("ejercicio").alias("cw"))
    s = model.services(spark, d).select("ejercicio", "seccion_cod", "servicio_cod", "servicio_denominacion").join(lead, ["seccion_cod", "servicio_cod"], "left")
    return s.select("ejercicio", "seccion_cod", "servicio_cod", "servicio_denominacion", "dir3_cod", F.when(F.col("dir3_cod").isNotNull() & (F.col("ejercicio") != F.col("cw")), 1).otherwise(0).alias("aproximado"))


def programmes(spark: SparkSession, d: str) -> DataFrame:
    """G-04, K-05: programmes with the prefixes that make their hierarchy."""
    return model.execution(spark, d).select("programa_cod", *[F.substring("programa_cod", 1, n).alias(c) for c, n in (("area", 1), ("politica", 2), ("grupo", 3))]).distinct()


#: Level of an economic code by its length.
ECONOMIC_LEVEL = {1: "capitulo", 2: "articulo", 3: "concepto", 5: "subconcepto", 7: "partida"}


def economics(spark: SparkSession, d: str) -> DataFrame:
    """G-04, K-06: economic codes and their two-digit ancestors, with level and parent."""
    own = model.execution(spark, d).select("economica_cod")
    all_codes = own.unionByName(own.select(F.substring("economica_cod", 1, 2).alias("economica_cod"))).distinct()
    n = F.length("economica_cod")
    level = F.coalesce(*[F.when(n == k, v) for k, v in ECONOMIC_LEVEL.items()])
    return all_codes.select("economica_cod", level.alias("nivel"), F.when(n > 1, F.substring("economica_cod", 1, 1)).alias("capitulo"))


def modal_labels(spark: SparkSession, d: str) -> DataFrame:
    """K-07, A-14: most frequent label of each economic code over all facts, the smallest of equally frequent ones."""
    n = model.execution(spark, d).where("aplicacion_denominacion IS NOT NULL").groupBy("economica_cod", "aplicacion_denominacion").agg(F.count("*").alias("n"))
    best = n.groupBy("economica_cod").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("aplicacion_denominacion").alias("l"))).alias("b"))
    return best.select("economica_cod", F.col("b.l").alias("denominacion"), (-F.col("b.n")).alias("n"))


def periods(spark: SparkSession, d: str) -> DataFrame:
    """K-03: months with their last day and, where the dimension knows the year, the smallest budget label."""
    label = model.services(spark, d).groupBy("ejercicio").agg(F.min("presupuesto").alias("presupuesto"))
    p = model.execution(spark, d).select("periodo", "ejercicio").distinct()
    return p.join(F.broadcast(label), "ejercicio", "left").select("periodo", "ejercicio", F.substring("periodo", 6, 2).cast("int").alias("mes"), F.last_day(F.to_date(F.concat("periodo", F.lit("-01")))).alias("fin"), "presupuesto", F.when(F.upper(F.trim("presupuesto")).endswith("-P"), 1).otherwise(0).alias("prorrogado"))


FACTS = {"fact_ejecucion": "contable", "fact_contratos": "compromisos_juridicos", "fact_subvenciones": "compromisos_juridicos"}


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """G-05, A-09, U-01: rows, captures and periods of each source."""
    parts = [table(spark, d, t).groupBy("fuente_cod").agg(F.count("*").alias("n"), F.max("fecha_captura").alias("ultima"), F.min("periodo").alias("desde"), F.max("periodo").alias("hasta")).withColumn("velocidad", F.lit(v)) for t, v in FACTS.items()]
    return reduce(DataFrame.unionByName, parts)


#: Sources with the speed of what they tell and how often they come.
SOURCES = {"igae_anexo_i": ("contable", "mensual"), "placsp": ("compromisos_juridicos", "diaria"), "bdns": ("compromisos_juridicos", "diaria"), "boe_sumario": ("decisiones_politicas", "diaria"), "consejo_ministros": ("decisiones_politicas", "semanal")}


def sources(spark: SparkSession, d: str) -> DataFrame:
    """G-04, G-05: every source, also one without rows, with its rows, last capture, periods, and how far behind the newest capture of any
    source it is (F-25)."""
    known = spark.createDataFrame([(k, *v) for k, v in SOURCES.items()], "fuente_cod string, velocidad string, periodicidad string")
    facts = freshness(spark, d).drop("velocidad")
    month = F.date_format("fecha", "yyyy-MM")
    texts = table(spark, d, "documents").where(F.col("source").isin("boe_sumario", "consejo_ministros")).groupBy(F.col("source").alias("fuente_cod")).agg(F.count("*").alias("n"), F.max("fecha").alias("ultima"), F.min(month).alias("desde"), F.max(month).alias("hasta"))
    j = known.join(facts.unionByName(texts), "fuente_cod", "left").na.fill(0, ["n"])
    newest = j.agg(F.max("ultima").alias("hoy")).withColumn("u", F.lit(1))
    state = ops.light("ultima", "periodicidad", F.col("hoy"))
    return j.withColumn("u", F.lit(1)).join(F.broadcast(newest), "u").select(*j.columns, state.alias("estado"))


def against_last_year(year: int = metrics.YEAR):
    """G-08: degree of each month of a year beside that of the same month a year before."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        keep = F.col("periodo").startswith(f"{year}-") | F.col("periodo").startswith(f"{year - 1}-")
        s = metrics.sums(spark, d, "age", keep).withColumn("mes", F.substring("periodo", 6, 2).cast("int")).withColumn("pct", ratio("orn", "credito_definitivo", 100.0))
        side = lambda y: F.round(F.max(F.when(F.col("periodo").startswith(f"{y}-"), F.col("pct"))), 4)
        return s.groupBy("mes").agg(side(year).alias("pct"), side(year - 1).alias("pct_anterior"))

    return query


def largest_service(period: str = metrics.MONTH):
    """G-08: the service of the largest final appropriation of each section in a period (the smallest code of several)."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        s = metrics.sums(spark, d, "servicio", F.col("periodo") == period).where("credito_definitivo IS NOT NULL")
        best = s.groupBy("seccion_cod").agg(F.min(F.struct((-F.col("credito_definitivo")).alias("c"), F.col("servicio_cod").alias("s"))).alias("b"))
        return best.select("seccion_cod", F.col("b.s").alias("servicio_cod"), (-F.col("b.c")).alias("credito_definitivo"))

    return query


def heads(n: int = 15):
    """O-09: the n largest amounts of contracts by service in a year, ties by code."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        v = metrics.volume("contratos", "servicio")(spark, d)
        return v.orderBy(F.desc_nulls_last("importe"), "seccion_cod", "servicio_cod").limit(n)

    return query


def health(spark: SparkSession, d: str) -> DataFrame:
    """G-06, A-18: months loaded and last capture of any table."""
    months = model.execution(spark, d).agg(F.countDistinct("periodo").alias("periodos"))
    last = reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.max("fecha_captura").alias("c")) for t in FACTS]).agg(F.max("c").alias("ultima_captura"))
    return months.withColumn("u", F.lit(1)).join(last.withColumn("u", F.lit(1)), "u").drop("u")


def tender_heads(spark: SparkSession, d: str) -> DataFrame:
    """Budget of a month over head rows, awards over all lots: a tender's budget counts once."""
    c = model.contracts(spark, d)
    return c.groupBy("periodo").agg(money(F.when(F.col("es_cabecera_expediente"), F.col("presupuesto_sin_iva"))).alias("presupuesto"), money("importe_adjudicacion").alias("adjudicado"), F.countDistinct("licitacion_id").alias("licitaciones"))


def latest_photo(spark: SparkSession, d: str) -> DataFrame:
    """W-04: of each tender the lots of its last delivery, by running count of capture changes."""
    rows = table(spark, d, "fact_contratos").select("licitacion_id", "lote_id", "fecha_captura", "importe_adjudicacion").distinct()
    return latest_block(rows, "licitacion_id", ["fecha_captura", "lote_id"], "fecha_captura").groupBy("licitacion_id").agg(F.max("fecha_captura").alias("fecha_captura"), F.count("*").alias("lotes"))


def republished(spark: SparkSession, d: str) -> DataFrame:
    """W-05: grants whose amount changed on republication, first and last amount."""
    rows = table(spark, d, "fact_subvenciones").where("importe IS NOT NULL").select("concesion_id", "fecha_captura", "importe")
    g = rows.groupBy("concesion_id").agg(F.min(F.struct("fecha_captura", "importe")).alias("a"), F.max(F.struct("fecha_captura", "importe")).alias("b"))
    return g.where("a.importe <> b.importe").select("concesion_id", F.col("a.importe").alias("primero"), F.col("b.importe").alias("ultimo"))


def previous_month(spark: SparkSession, d: str) -> DataFrame:
    """W-07: each loaded month with the one loaded before it in its year."""
    m = model.execution(spark, d).select("ejercicio", "periodo").distinct()
    return m.withColumn("anterior", F.lag("periodo").over(Window.partitionBy("ejercicio").orderBy("periodo")))


def page(number: int = 2, size: int = 50):
    """O-01, O-07: a page of the services by degree, nulls last, ties by code."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = metrics.degree("servicio")(spark, d).select("seccion_cod", "servicio_cod", "pct_ejecucion")
        return rows.orderBy(F.desc_nulls_last("pct_ejecucion"), "seccion_cod", "servicio_cod").offset((number - 1) * size).limit(size)

    return query


def revisions(spark: SparkSession, d: str) -> DataFrame:
    """K-22: published files of a source and period that came with more than one content."""
    rows = table(spark, d, "revision_captura").select("fuente", codes.period("periodo").alias("periodo"), "fichero_cod", codes.hash16("hash_nuevo").alias("h"))
    n = rows.groupBy("fuente", "periodo", "fichero_cod").agg(F.countDistinct("h").alias("versiones"))
    return n.where("versiones > 1").groupBy("fuente", "periodo").agg(F.count("*").alias("ficheros"), F.max("versiones").alias("versiones"))


def unresolved(spark: SparkSession, d: str) -> DataFrame:
    """K-04: sections and services of the facts that the dimension lacks, with the smallest label they come with."""
    known = model.services(spark, d).select("ejercicio", "seccion_cod", "servicio_cod")
    return model.execution(spark, d).join(known, ["ejercicio", "seccion_cod", "servicio_cod"], "left_anti").groupBy("ejercicio", "seccion_cod", "servicio_cod").agg(F.min("aplicacion_denominacion").alias("etiqueta"))


QUERIES = {
    "g01_ejercicios": years, "g02_secciones": sections, "g03_servicios": services, "g04_programas": programmes, "g04_economicas": economics, "k07_etiqueta_modal": modal_labels, "k03_periodos": periods, "k04_sin_dimension": unresolved,
    "g05_frescura": freshness, "g06_salud": health, "a05_cabeceras": tender_heads, "w04_ultima_foto": latest_photo, "w05_republicadas": republished, "w07_mes_anterior": previous_month, "o07_pagina": page(), "k22_revisiones": revisions,
    "g04_fuentes": sources, "g08_serie_superpuesta": against_last_year(), "g08_mayor_credito": largest_service(), "o09_cabezas": heads(),
}

_m = metrics._money
SQL = {
    "g01_ejercicios": f"WITH {model.EXECUTION} SELECT DISTINCT ejercicio FROM ej",
    "g02_secciones": f"WITH {model.SERVICES} SELECT ejercicio, seccion_cod, max(seccion_denominacion) AS seccion_denominacion, count(DISTINCT servicio_cod) AS n_servicios FROM sv GROUP BY 1, 2",
    "g03_servicios": f"""WITH {model.BRIDGE}, {model.UNITS}, {metrics._UNIT}, {model.SERVICES}, l AS (SELECT * FROM dgu WHERE ejercicio = (SELECT max(ejercicio) FROM br))
SELECT sv.ejercicio, sv.seccion_cod, sv.servicio_cod, servicio_denominacion, l.dir3_cod, CASE WHEN l.dir3_cod IS NOT NULL AND sv.ejercicio <> l.ejercicio THEN 1 ELSE 0 END AS aproximado FROM sv LEFT JOIN l ON l.seccion_cod = sv.seccion_cod AND l.servicio_cod = sv.servicio_cod""",
    "g04_programas": f"WITH {model.EXECUTION} SELECT DISTINCT programa_cod, left(programa_cod, 1) AS area, left(programa_cod, 2) AS politica, left(programa_cod, 3) AS grupo FROM ej",
    "g04_economicas": f"""WITH {model.EXECUTION}, c AS (SELECT economica_cod FROM ej UNION SELECT left(economica_cod, 2) FROM ej)
SELECT economica_cod, CASE length(economica_cod) {" ".join(f"WHEN {k} THEN '{v}'" for k, v in ECONOMIC_LEVEL.items())} END AS nivel, CASE WHEN length(economica_cod) > 1 THEN left(economica_cod, 1) END AS capitulo FROM c""",
    "k07_etiqueta_modal": f"""WITH {model.EXECUTION}, n AS (SELECT economica_cod, aplicacion_denominacion, count(*) AS n FROM ej WHERE aplicacion_denominacion IS NOT NULL GROUP BY 1, 2)
SELECT economica_cod, aplicacion_denominacion AS denominacion, n FROM n QUALIFY row_number() OVER (PARTITION BY economica_cod ORDER BY n DESC, aplicacion_denominacion) = 1""",
    "k03_periodos": f"""WITH {model.EXECUTION}, {model.SERVICES}, l AS (SELECT ejercicio, min(presupuesto) AS presupuesto FROM sv GROUP BY 1), p AS (SELECT DISTINCT periodo, ejercicio FROM ej)
SELECT periodo, p.ejercicio, CAST(substr(periodo, 6, 2) AS INT) AS mes, last_day(CAST(periodo || '-01' AS DATE)) AS fin, presupuesto, CASE WHEN upper(trim(presupuesto)) LIKE '%-P' THEN 1 ELSE 0 END AS prorrogado FROM p LEFT JOIN l USING (ejercicio)""",
    "k04_sin_dimension": f"WITH {model.EXECUTION}, {model.SERVICES} SELECT ejercicio, seccion_cod, servicio_cod, min(aplicacion_denominacion) AS etiqueta FROM ej ANTI JOIN sv USING (ejercicio, seccion_cod, servicio_cod) GROUP BY 1, 2, 3",
    "g05_frescura": " UNION ALL ".join(f"SELECT fuente_cod, count(*) AS n, max(fecha_captura) AS ultima, min(periodo) AS desde, max(periodo) AS hasta, '{v}' AS velocidad FROM {t} GROUP BY 1" for t, v in FACTS.items()),
    "g06_salud": f"WITH {model.EXECUTION} SELECT (SELECT count(DISTINCT periodo) FROM ej) AS periodos, (SELECT max(c) FROM ({' UNION ALL '.join(f'SELECT max(fecha_captura) AS c FROM {t}' for t in FACTS)})) AS ultima_captura",
    "a05_cabeceras": f"WITH {model.CONTRACTS} SELECT periodo, {_m('CASE WHEN es_cabecera_expediente THEN presupuesto_sin_iva END')} AS presupuesto, {_m('importe_adjudicacion')} AS adjudicado, count(DISTINCT licitacion_id) AS licitaciones FROM ct GROUP BY 1",
    "w04_ultima_foto": """WITH r AS (SELECT DISTINCT licitacion_id, lote_id, fecha_captura, importe_adjudicacion FROM fact_contratos)
SELECT licitacion_id, fecha_captura, count(*) AS lotes FROM (SELECT *, max(fecha_captura) OVER (PARTITION BY licitacion_id) AS m FROM r) WHERE fecha_captura = m GROUP BY 1, 2""",
    "w05_republicadas": """WITH g AS (SELECT concesion_id, min((fecha_captura, importe)) AS a, max((fecha_captura, importe)) AS b FROM fact_subvenciones WHERE importe IS NOT NULL GROUP BY 1)
SELECT concesion_id, a[2] AS primero, b[2] AS ultimo FROM g WHERE a[2] <> b[2]""",
    "w07_mes_anterior": f"WITH {model.EXECUTION}, m AS (SELECT DISTINCT ejercicio, periodo FROM ej) SELECT *, lag(periodo) OVER (PARTITION BY ejercicio ORDER BY periodo) AS anterior FROM m",
    "o07_pagina": f"WITH q AS ({metrics.SQL['m01_grado_servicio']}) SELECT seccion_cod, servicio_cod, pct_ejecucion FROM q ORDER BY pct_ejecucion DESC NULLS LAST, seccion_cod, servicio_cod LIMIT 50 OFFSET 50",
    "k22_revisiones": r"""WITH r AS (SELECT fuente, fichero_cod, trim(periodo) AS t, regexp_replace(lower(trim(hash_nuevo)), '^(sha-?256:|0x)', '') AS h FROM revision_captura),
n AS (SELECT fuente, fichero_cod, CASE WHEN regexp_matches(t, '^\d{1,2}/\d{4}$') THEN split_part(t, '/', 2) || '-' || lpad(split_part(t, '/', 1), 2, '0') ELSE left(t, 4) || '-' || lpad(ltrim(substr(t, 5), '-/'), 2, '0') END AS periodo,
  CASE WHEN regexp_matches(h, '^[0-9a-f]{16}$') THEN h END AS h FROM r), c AS (SELECT fuente, periodo, fichero_cod, count(DISTINCT h) AS v FROM n GROUP BY 1, 2, 3)
SELECT fuente, periodo, count(*) AS ficheros, max(v) AS versiones FROM c WHERE v > 1 GROUP BY 1, 2""",
    "g04_fuentes": f"""WITH k(fuente_cod, velocidad, periodicidad) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in SOURCES.items())}),
f AS ({" UNION ALL ".join(f"SELECT fuente_cod, count(*) AS n, max(fecha_captura) AS ultima, min(periodo) AS desde, max(periodo) AS hasta FROM {t} GROUP BY 1" for t in FACTS)} UNION ALL
  SELECT source, count(*), max(fecha), min(strftime(fecha, '%Y-%m')), max(strftime(fecha, '%Y-%m')) FROM documents WHERE source IN ('boe_sumario', 'consejo_ministros') GROUP BY 1),
j AS (SELECT fuente_cod, velocidad, periodicidad, coalesce(n, 0) AS n, ultima, desde, hasta FROM k LEFT JOIN f USING (fuente_cod)),
a AS (SELECT *, date_diff('day', ultima, (SELECT max(ultima) FROM j)) AS dias, CASE periodicidad {" ".join(f"WHEN '{k}' THEN {v}" for k, v in ops.CADENCE.items())} END AS tope FROM j)
SELECT fuente_cod, velocidad, periodicidad, n, ultima, desde, hasta, CASE WHEN dias IS NULL THEN 'sin_datos' WHEN dias <= tope THEN 'verde' WHEN dias <= 2 * tope THEN 'ambar' ELSE 'rojo' END AS estado FROM a""",
    "g08_serie_superpuesta": metrics._sums("age", f"left(periodo, 4) IN ('{metrics.YEAR}', '{metrics.YEAR - 1}')") + f", q AS (SELECT *, 100.0 * orn / nullif(credito_definitivo, 0) AS pct FROM s) SELECT CAST(substr(periodo, 6, 2) AS INT) AS mes, round(max(pct) FILTER (WHERE left(periodo, 4) = '{metrics.YEAR}'), 4) AS pct, round(max(pct) FILTER (WHERE left(periodo, 4) = '{metrics.YEAR - 1}'), 4) AS pct_anterior FROM q GROUP BY 1",
    "g08_mayor_credito": metrics._sums("servicio", f"periodo = '{metrics.MONTH}'") + " SELECT seccion_cod, servicio_cod, credito_definitivo FROM s WHERE credito_definitivo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seccion_cod ORDER BY credito_definitivo DESC, servicio_cod) = 1",
    "o09_cabezas": f"WITH {metrics._volume('contratos', 'servicio', metrics.YEAR)} SELECT * FROM v ORDER BY importe DESC NULLS LAST, seccion_cod, servicio_cod LIMIT 15",
}
