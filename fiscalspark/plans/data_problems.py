"""Queries p2 to p5: the general data problems over the public-budget tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.functions import codes
from fiscalspark.operators import asof, hierarchy, orphans, snapshot_diff
from fiscalspark.sources.tables import table

def key() -> Column:
    return codes.budget_key("ejercicio", "seccion_cod", "servicio_cod")


#: Table and the text that names a record of it.
REFERRING = {
    "fact_ejecucion": "CAST(registro_id AS STRING)",
    "fact_subvenciones": "concesion_id",
    "fact_contratos": "concat(licitacion_id, '#', lote_id)",
}


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference to dim_seccion_servicio, one row per delivery."""
    parts = [
        table(spark, sf_dir, t)
        .where("seccion_cod IS NOT NULL AND servicio_cod IS NOT NULL")
        .select(F.lit(t).alias("tabla"), F.expr(clave).alias("clave"), "periodo", key().alias("key"), F.col("fecha_captura").alias("c"))
        for t, clave in REFERRING.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def budget_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dim_seccion_servicio").select(key().alias("key"), F.col("fecha_captura").alias("desde"), F.col("fecha_baja").alias("hasta"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(references(spark, sf_dir), budget_keys(spark, sf_dir))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "fact_subvenciones").select(F.col("concesion_id").alias("id"), codes.dir3("anclaje_dir3_cod").alias("unit"), F.col("fecha_concesion").alias("day"))
    versions = table(spark, sf_dir, "dim_organica").select(codes.dir3("dir3_cod").alias("unit"), F.col("fecha_inicio").alias("ini"), F.col("fecha_fin").alias("fin"), F.col("fecha_captura").alias("cap"), F.col("version_id").alias("vid"))
    return asof.as_known(events, versions).select(F.col("id").alias("concesion_id"), F.col("vid").alias("version_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "revision_captura").select(
        F.col("fuente").alias("grp"), F.col("captura_num").alias("num"), F.col("entrega_ts").alias("delivered"), codes.period("periodo").alias("periodo"), "fichero_cod", codes.hash16("hash_nuevo").alias("hash")
    )
    found = snapshot_diff.snapshot_changes(rows, ["periodo", "fichero_cod"], "hash")
    return found.select(F.col("grp").alias("fuente"), "periodo", "fichero_cod", F.col("num").alias("captura_num"), "cambio")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("fuente", "captura_num", "cambio").agg(F.count("*").alias("n"))


def unit_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dim_organica").select(
        codes.dir3("dir3_cod").alias("code"), codes.dir3("dir3_padre_cod").alias("parent"), F.col("nivel_jerarquico").cast("int").alias("level"), F.struct("fecha_inicio", "fecha_captura", "version_id").alias("ord")
    )
    return hierarchy.hierarchy(rows)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    differs = (F.col("loop") == 0) & F.col("level").isNotNull() & (F.col("level") != F.col("depth"))
    return unit_tree(spark, sf_dir).select(
        F.col("code").alias("dir3_cod"), F.col("root").alias("raiz_cod"), F.col("depth").alias("profundidad"), F.col("path").alias("ruta"), F.col("below").cast("int").alias("n_descendientes"), F.when(differs, 1).otherwise(0).alias("nivel_difiere"), F.col("loop").alias("ciclo")
    )


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the SQL joins 'down', which has no unit on or below a loop; the operator itself gives their rows too
    return hierarchy.descendants(unit_tree(spark, sf_dir).where("loop = 0")).select(F.col("ancestor").alias("dir3_cod"), F.col("descendant").alias("descendiente_cod"), F.col("distance").alias("distancia"))


def p5_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit with every other unit below it, also on loops and below them, and the fewest links down to it."""
    return hierarchy.descendants(unit_tree(spark, sf_dir)).select(F.col("ancestor").alias("dir3_cod"), F.col("descendant").alias("descendiente_cod"), F.col("distance").alias("distancia"))


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p4_found, p4_report, p5_found, p5_descendants, p5_below)}

_KEY_SQL = "ejercicio AS e, TRY_CAST(trim(seccion_cod) AS INT) AS a, TRY_CAST(trim(servicio_cod) AS INT) AS b"
_P2 = f"""
WITH refs AS (
  SELECT 'fact_ejecucion' AS tabla, CAST(registro_id AS VARCHAR) AS clave, periodo, fecha_captura AS c, {_KEY_SQL}
  FROM fact_ejecucion WHERE seccion_cod IS NOT NULL AND servicio_cod IS NOT NULL
  UNION ALL SELECT 'fact_subvenciones', concesion_id, periodo, fecha_captura, {_KEY_SQL}
  FROM fact_subvenciones WHERE seccion_cod IS NOT NULL AND servicio_cod IS NOT NULL
  UNION ALL SELECT 'fact_contratos', licitacion_id || '#' || lote_id, periodo, fecha_captura, {_KEY_SQL}
  FROM fact_contratos WHERE seccion_cod IS NOT NULL AND servicio_cod IS NOT NULL
), rec AS (
  SELECT tabla, clave, min(c) AS c, arg_min(periodo, c) AS periodo, arg_min(e, c) AS e, arg_min(a, c) AS a, arg_min(b, c) AS b
  FROM refs GROUP BY tabla, clave
), dim AS (SELECT {_KEY_SQL}, fecha_captura AS d, fecha_baja AS h FROM dim_seccion_servicio),
judged AS (
  SELECT r.tabla, r.clave, r.periodo, count(dim.e) AS n,
    count(*) FILTER (WHERE dim.d <= r.c AND (dim.h IS NULL OR dim.h > r.c)) AS alive,
    count(*) FILTER (WHERE dim.d <= r.c) AS known
  FROM rec r LEFT JOIN dim ON r.e = dim.e AND r.a = dim.a AND r.b = dim.b
  GROUP BY r.tabla, r.clave, r.periodo
), found AS (
  SELECT tabla, clave, periodo, CASE WHEN n = 0 THEN 'inexistente' WHEN known > 0 THEN 'borrada' ELSE 'tardia' END AS motivo
  FROM judged WHERE alive = 0
)"""
_P4 = r"""
WITH r AS (
  SELECT fuente, captura_num, entrega_ts, fichero_cod, trim(periodo) AS t,
    regexp_replace(lower(trim(hash_nuevo)), '^(sha-?256:|0x)', '') AS h
  FROM revision_captura
), n AS (
  SELECT fuente, captura_num, entrega_ts, fichero_cod,
    CASE WHEN regexp_matches(t, '^\d{1,2}/\d{4}$') THEN split_part(t, '/', 2) || '-' || lpad(split_part(t, '/', 1), 2, '0')
         ELSE left(t, 4) || '-' || lpad(ltrim(substr(t, 5), '-/'), 2, '0') END AS periodo,
    CASE WHEN regexp_matches(h, '^[0-9a-f]{16}$') THEN h END AS h
  FROM r
), last AS (SELECT fuente, captura_num, max(entrega_ts) AS entrega_ts FROM n GROUP BY 1, 2),
seq AS (SELECT *, lag(captura_num) OVER (PARTITION BY fuente ORDER BY captura_num) AS prev FROM last),
s AS (SELECT DISTINCT n.fuente, n.captura_num, n.periodo, n.fichero_cod, n.h FROM n JOIN last USING (fuente, captura_num, entrega_ts)),
neu AS (SELECT s.*, seq.prev FROM s JOIN seq USING (fuente, captura_num) WHERE seq.prev IS NOT NULL),
old AS (SELECT s.fuente, s.periodo, s.fichero_cod, s.h, seq.captura_num FROM s JOIN seq ON s.fuente = seq.fuente AND s.captura_num = seq.prev),
pair AS (
  SELECT coalesce(neu.fuente, old.fuente) AS fuente, coalesce(neu.periodo, old.periodo) AS periodo,
    coalesce(neu.fichero_cod, old.fichero_cod) AS fichero_cod, coalesce(neu.captura_num, old.captura_num) AS captura_num,
    CASE WHEN old.fuente IS NULL THEN 'alta' WHEN neu.fuente IS NULL THEN 'baja' WHEN neu.h <> old.h THEN 'cambio' END AS cambio
  FROM neu FULL JOIN old ON neu.fuente = old.fuente AND neu.periodo = old.periodo
    AND neu.fichero_cod = old.fichero_cod AND neu.captura_num = old.captura_num
), found AS (SELECT * FROM pair WHERE cambio IS NOT NULL)"""
_P5 = """
WITH RECURSIVE r AS (
  SELECT nullif(upper(trim(dir3_cod)), '') AS code, nullif(upper(trim(dir3_padre_cod)), '') AS p, nivel_jerarquico AS lv,
    row_number() OVER (PARTITION BY nullif(upper(trim(dir3_cod)), '') ORDER BY fecha_inicio DESC, fecha_captura DESC, version_id DESC) AS k
  FROM dim_organica
), u AS (SELECT code, p, lv FROM r WHERE k = 1 AND code IS NOT NULL),
n AS (SELECT u.code, CASE WHEN u.p <> u.code AND v.code IS NOT NULL THEN u.p END AS parent, u.lv FROM u LEFT JOIN u v ON u.p = v.code),
down(code, raiz, d, ruta) AS (
  SELECT code, code, 1, code FROM n WHERE parent IS NULL
  UNION ALL SELECT n.code, down.raiz, down.d + 1, down.ruta || '/' || n.code FROM n JOIN down ON n.parent = down.code
), up(code, anc) AS (
  SELECT code, parent FROM n WHERE parent IS NOT NULL
  UNION SELECT up.code, n.parent FROM up JOIN n ON up.anc = n.code WHERE n.parent IS NOT NULL
), cnt AS (SELECT anc AS code, count(*) AS k FROM up WHERE anc <> code GROUP BY anc),
onloop AS (SELECT code FROM up WHERE code = anc)"""
SQL = {
    "p2_found": _P2 + " SELECT * FROM found",
    "p2_report": _P2 + " SELECT tabla, periodo, motivo, count(*) AS n FROM found GROUP BY ALL",
    "p3_found": """
WITH g AS (SELECT DISTINCT concesion_id, upper(trim(anclaje_dir3_cod)) AS u, fecha_concesion AS d FROM fact_subvenciones
  WHERE fecha_concesion IS NOT NULL AND anclaje_dir3_cod IS NOT NULL),
v AS (SELECT g.concesion_id, g.d, o.version_id, o.fecha_inicio, o.fecha_fin,
    row_number() OVER (PARTITION BY g.concesion_id, o.fecha_inicio ORDER BY o.fecha_captura DESC, o.version_id DESC) AS k
  FROM g JOIN dim_organica o ON upper(trim(o.dir3_cod)) = g.u AND o.fecha_captura <= g.d AND o.fecha_inicio IS NOT NULL)
SELECT concesion_id, arg_max(version_id, fecha_inicio) AS version_id FROM v
WHERE k = 1 AND fecha_inicio <= d AND (fecha_fin IS NULL OR fecha_fin >= d) GROUP BY concesion_id""",
    "p4_found": _P4 + " SELECT * FROM found",
    "p4_report": _P4 + " SELECT fuente, captura_num, cambio, count(*) AS n FROM found GROUP BY ALL",
    "p5_found": _P5
    + """
SELECT n.code AS dir3_cod, coalesce(down.raiz, '') AS raiz_cod, CAST(coalesce(down.d, 0) AS INT) AS profundidad, coalesce(down.ruta, '') AS ruta,
  CAST(coalesce(cnt.k, 0) AS INT) AS n_descendientes,
  CASE WHEN down.d IS NOT NULL AND n.lv IS NOT NULL AND n.lv <> down.d THEN 1 ELSE 0 END AS nivel_difiere,
  CASE WHEN down.d IS NOT NULL THEN 0 WHEN onloop.code IS NOT NULL THEN 1 ELSE 2 END AS ciclo
FROM n LEFT JOIN down USING (code) LEFT JOIN cnt USING (code) LEFT JOIN onloop USING (code)""",
    "p5_below": _P5
    + """, lv(code, anc, dist, seen) AS (
  SELECT code, parent, 1, [code] FROM n WHERE parent IS NOT NULL
  UNION ALL SELECT lv.code, n.parent, lv.dist + 1, list_append(lv.seen, lv.anc) FROM lv JOIN n ON lv.anc = n.code WHERE n.parent IS NOT NULL AND NOT list_contains(lv.seen, lv.anc))
SELECT anc AS dir3_cod, code AS descendiente_cod, min(dist) AS distancia FROM lv WHERE anc <> code GROUP BY 1, 2""",
    "p5_descendants": _P5
    + """, lv(code, anc, dist) AS (
  SELECT code, parent, 1 FROM n WHERE parent IS NOT NULL
  UNION ALL SELECT lv.code, n.parent, lv.dist + 1 FROM lv JOIN n ON lv.anc = n.code WHERE n.parent IS NOT NULL AND lv.dist < 200)
SELECT lv.anc AS dir3_cod, lv.code AS descendiente_cod, lv.dist AS distancia FROM lv JOIN down USING (code)""",
}
