"""Anchoring of records to the organic spine by code, and names of units (E-01 to E-03, E-07, E-08, F-01, F-02, F-06, F-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.functions import codes, text
from fiscalspark.operators.ascend import HOPS, ascend, nodes
from fiscalspark.operators.measures import money
from fiscalspark.plans import metrics, model
from fiscalspark.sources.tables import table

#: Fixed value: shape of a unit code.
UNIT = r"^[A-Z]{1,2}\d{7,8}$"


def targets(spark: SparkSession, d: str) -> DataFrame:
    """E-02: of each unit and year the smallest (section, service) that the crosswalk names."""
    return model.bridge(spark, d).select(F.col("dir3_cod").alias("code"), F.col("ejercicio").alias("year"), F.struct("seccion_cod", "servicio_cod").alias("target"))


def smallest_target(spark: SparkSession, d: str) -> DataFrame:
    return targets(spark, d).groupBy("code", "year").agg(F.min("target").alias("t")).select(F.col("code").alias("dir3_cod"), F.col("year").alias("ejercicio"), "t.seccion_cod", "t.servicio_cod")


def anchored(rows: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """E-01 over the delivered units and crosswalk, see anchored_by."""
    return anchored_by(rows, model.units(spark, d), targets(spark, d))


def anchored_by(rows: DataFrame, units: DataFrame, targets: DataFrame) -> DataFrame:
    """E-01: rows (id, code, day, year) with their anchor: section, service, unit, kind and signal. targets: code, year, target."""
    versions = units.select(F.col("dir3_cod").alias("code"), F.col("dir3_padre_cod").alias("parent"), F.col("tipo_entidad").alias("kind"), F.col("fecha_inicio").alias("ini"), F.col("fecha_fin").alias("fin"))
    good = rows.where(F.col("code").rlike(UNIT))
    done = ascend(good, nodes(versions, targets), own="MN")
    done = done.select(*[F.col(c).alias(f"_{c}") for c in ("code", "day", "year")], "end", "at", "known", "covered", "target")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("code", "day", "year")]
    j = rows.join(done, match, "left")
    bad = F.col("code").isNotNull() & ~F.col("code").rlike(UNIT)
    kind = F.when(F.col("code").isNull() | bad, "sin_anclar").when(F.col("end") == "destino", "servicio").when((F.col("end") == "propia") | F.col("known"), "organica_sin_servicio").otherwise("fuera_perimetro")
    signal = (
        F.when(F.col("code").isNull(), "sin_dir3").when(bad, "dir3_malformado").when(F.col("end") == "destino", F.when(F.col("at") == F.col("code"), "dir3_directo").otherwise("dir3_ancestro"))
        .when(F.col("end") == "propia", "entidad_instrumental").when(F.col("known") & F.col("covered"), "sin_servicio_en_cadena").when(F.col("known"), "ejercicio_sin_crosswalk").otherwise("dir3_no_age")
    )
    unit = F.when(kind == "servicio", F.col("at")).when(kind == "sin_anclar", None).otherwise(F.col("code"))
    return j.select("id", "target.seccion_cod", "target.servicio_cod", unit.alias("anclaje_dir3_cod"), kind.alias("anclaje_tipo"), signal.alias("anclaje_senal"))


def contract_anchors(spark: SparkSession, d: str) -> DataFrame:
    """E-03: anchors of the tenders by the unit code of their body, on the award day else the update day, in the year of the period."""
    rows = table(spark, d, "fact_contratos").groupBy("licitacion_id").agg(F.max(F.struct(F.coalesce("fecha_adjudicacion", "fecha_actualizacion").alias("day"), codes.dir3("organo_dir3_cod").alias("code"), F.substring("periodo", 1, 4).cast("int").alias("year"))).alias("r"))
    return anchored(rows.select(F.col("licitacion_id").alias("id"), "r.code", "r.day", "r.year"), spark, d).withColumnRenamed("id", "licitacion_id")


def unit_levels(spark: SparkSession, d: str) -> DataFrame:
    """E-08, F-06, F-19: versions with start (official, else capture), end (capture when no longer alive) and level by name and depth."""
    level = text.organic_level("denominacion", "nivel_jerarquico")
    u = model.units(spark, d)
    alive = F.col("estado").isin("V", "T")
    return u.select("dir3_cod", "version_id", F.coalesce("fecha_inicio", "fecha_captura").alias("inicio"), F.when(~alive, F.coalesce("fecha_fin", "fecha_captura")).alias("fin"), level["nivel"].alias("nivel"), level["senal"].alias("senal"))


def crosswalk_rules(spark: SparkSession, d: str) -> DataFrame:
    """E-07, J-18, J-20, J-21: units for the crosswalk's services by ordered rules within the ministry: equal name, equal words, unique front.

    Candidates of all rules are one union; the lowest rule of a row stays, of its candidates the smallest code. Those of the
    prefix rule meet by all words of the row but the last, which may go on in the unit's name.
    """
    rows = table(spark, d, "crosswalk_servicio_dir3").where("seccion_denominacion IS NOT NULL").groupBy("cruce_id").agg(F.max(F.struct("servicio_denominacion", "seccion_denominacion")).alias("r"))
    r = rows.select("cruce_id", text.normal("r.servicio_denominacion").alias("n"), text.token_key("r.servicio_denominacion").alias("k"), text.token_key("r.seccion_denominacion", "ministerio").alias("m"))
    u = model.units(spark, d).select("dir3_cod", text.normal("denominacion").alias("un"), text.token_key("denominacion").alias("uk"), text.token_key("ministerio_denominacion", "ministerio").alias("m")).distinct()
    exact = r.join(u, (r["m"] == u["m"]) & (r["n"] == u["un"])).select("cruce_id", F.lit(1).alias("rule"), "dir3_cod")
    words = r.join(u, (r["m"] == u["m"]) & (r["k"] == u["uk"])).select("cruce_id", F.lit(2).alias("rule"), "dir3_cod")
    words_of = F.split("n", " ")
    p = r.where("n <> ''").withColumn("f", F.array_join(F.slice(words_of, 1, F.size(words_of) - 1), " "))
    unit_words = F.split("un", " ")
    q = u.withColumn("j", F.explode(F.sequence(F.lit(0), F.size(unit_words) - 1))).withColumn("f", F.array_join(F.slice(unit_words, F.lit(1), F.col("j")), " "))
    starts = p.join(q, (p["m"] == q["m"]) & (p["f"] == q["f"])).where("startswith(un, n)").select("cruce_id", "dir3_cod").distinct()
    unique = starts.groupBy("cruce_id").agg(F.count("*").alias("c"), F.max("dir3_cod").alias("dir3_cod")).where("c = 1").select("cruce_id", F.lit(3).alias("rule"), "dir3_cod")
    best = exact.unionByName(words).unionByName(unique).groupBy("cruce_id").agg(F.min(F.struct("rule", "dir3_cod")).alias("b"))
    return best.select("cruce_id", F.col("b.rule").alias("regla"), F.col("b.dir3_cod").alias("dir3_cod"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """A-16, A-17: rows of the crosswalk by rule, with their percentage; 0 is no rule."""
    every = table(spark, d, "crosswalk_servicio_dir3").select("cruce_id").distinct()
    n = every.join(crosswalk_rules(spark, d), "cruce_id", "left").groupBy(F.coalesce("regla", F.lit(0)).alias("regla")).agg(F.count("*").alias("n"))
    total = every.agg(F.count("*").alias("t")).withColumn("u", F.lit(1))
    return n.withColumn("u", F.lit(1)).join(F.broadcast(total), "u").select("regla", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))


def normal_names(spark: SparkSession, d: str) -> DataFrame:
    """F-01, F-02: normal form and token key of the unit names."""
    return model.units(spark, d).select("denominacion").distinct().select("denominacion", text.normal("denominacion").alias("normal"), text.token_key("denominacion").alias("clave"))


def beneficiaries(spark: SparkSession, d: str) -> DataFrame:
    """F-07: grants by kind of beneficiary read from number and name in one field."""
    rows = table(spark, d, "fact_subvenciones").select("concesion_id", F.concat_ws(" ", "beneficiario_nif", "beneficiario_nombre").alias("b")).distinct()
    b = text.beneficiary("b")
    return rows.select(b["tipo"].alias("tipo"), b["nif"].alias("nif")).groupBy("tipo").agg(F.count("*").alias("n"), F.count("nif").alias("con_nif"))


QUERIES = {
    "e01_anclaje": contract_anchors, "e02_destino": smallest_target, "e07_cruce": crosswalk_rules, "e08_niveles": unit_levels, "a17_cobertura": coverage,
    "f01_nombres": normal_names, "f07_beneficiarios": beneficiaries,
}


def _normal(c: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for p, full in text.FRONT.items():
        t = f"regexp_replace({t}, '{p}', '{full}')"
    return t


def _key(c: str, *more: str) -> str:
    stop = ", ".join(f"'{w}'" for w in (*text.STOPWORDS, *more))
    return f"array_to_string(list_sort(list_distinct(list_filter(string_split({_normal(c)}, ' '), lambda x: x NOT IN ({stop})))), ' ')"


_CLIMB = f"""tg AS (SELECT dir3_cod, ejercicio, min((seccion_cod, servicio_cod)) AS t FROM br GROUP BY 1, 2),
asc_ AS (SELECT id, day, year, code, code AS cur, 0 AS hop FROM rq WHERE regexp_matches(code, '{UNIT}')
  UNION ALL SELECT a.id, a.day, a.year, a.code, v.dir3_padre_cod, a.hop + 1
  FROM asc_ a JOIN (SELECT a2.dir3_cod, a2.dir3_padre_cod, a2.tipo_entidad, a2.fecha_inicio, a2.fecha_fin FROM un a2) v ON v.dir3_cod = a.cur AND CASE WHEN a.day IS NULL THEN v.fecha_fin IS NULL ELSE v.fecha_inicio <= a.day AND (v.fecha_fin IS NULL OR v.fecha_fin >= a.day) END
  WHERE a.hop < {HOPS - 1} AND NOT EXISTS (SELECT 1 FROM tg WHERE tg.dir3_cod = a.cur AND tg.ejercicio = a.year)
    AND NOT EXISTS (SELECT 1 FROM un w WHERE w.dir3_cod = a.cur AND CASE WHEN a.day IS NULL THEN w.fecha_fin IS NULL ELSE w.fecha_inicio <= a.day AND (w.fecha_fin IS NULL OR w.fecha_fin >= a.day) END AND w.fecha_inicio > v.fecha_inicio)
    AND (v.tipo_entidad IS NULL OR v.tipo_entidad = 'MN') AND v.dir3_padre_cod IS NOT NULL AND v.dir3_padre_cod <> a.cur),
l AS (SELECT * FROM asc_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop DESC) = 1),
e AS (SELECT l.id, l.code, l.cur, l.year, tg.t, (SELECT arg_max(tipo_entidad, fecha_inicio) FROM (SELECT coalesce(tipo_entidad, 'MN') AS tipo_entidad, fecha_inicio FROM un w WHERE w.dir3_cod = l.cur AND CASE WHEN l.day IS NULL THEN w.fecha_fin IS NULL ELSE w.fecha_inicio <= l.day AND (w.fecha_fin IS NULL OR w.fecha_fin >= l.day) END)) AS k,
  EXISTS (SELECT 1 FROM un WHERE un.dir3_cod = l.code) AS known, EXISTS (SELECT 1 FROM br WHERE br.ejercicio = l.year) AS covered FROM l LEFT JOIN tg ON tg.dir3_cod = l.cur AND tg.ejercicio = l.year),
an AS (SELECT rq.id, t[1] AS seccion_cod, t[2] AS servicio_cod,
  CASE WHEN e.code IS NULL THEN NULL WHEN t IS NOT NULL THEN cur ELSE e.code END AS anclaje_dir3_cod,
  CASE WHEN e.code IS NULL THEN 'sin_anclar' WHEN t IS NOT NULL THEN 'servicio' WHEN k <> 'MN' OR known THEN 'organica_sin_servicio' ELSE 'fuera_perimetro' END AS anclaje_tipo,
  CASE WHEN rq.code IS NULL THEN 'sin_dir3' WHEN e.code IS NULL THEN 'dir3_malformado' WHEN t IS NOT NULL THEN CASE WHEN cur = e.code THEN 'dir3_directo' ELSE 'dir3_ancestro' END
    WHEN k <> 'MN' THEN 'entidad_instrumental' WHEN known AND covered THEN 'sin_servicio_en_cadena' WHEN known THEN 'ejercicio_sin_crosswalk' ELSE 'dir3_no_age' END AS anclaje_senal
FROM rq LEFT JOIN e USING (id))"""
_ASCENT = f"""WITH RECURSIVE {model.UNITS}, {model.BRIDGE},
r AS (SELECT licitacion_id, max((coalesce(fecha_adjudicacion, fecha_actualizacion), nullif(upper(trim(organo_dir3_cod)), ''), CAST(left(periodo, 4) AS INT))) AS x FROM fact_contratos GROUP BY 1),
rq AS (SELECT licitacion_id AS id, x[1] AS day, x[2] AS code, x[3] AS year FROM r), {_CLIMB}
SELECT id AS licitacion_id, seccion_cod, servicio_cod, anclaje_dir3_cod, anclaje_tipo, anclaje_senal FROM an"""
_CROSS = f"""WITH {model.UNITS}, r0 AS (SELECT cruce_id, max((servicio_denominacion, seccion_denominacion)) AS r FROM crosswalk_servicio_dir3 WHERE seccion_denominacion IS NOT NULL GROUP BY 1),
r AS (SELECT cruce_id, {_normal("r[1]")} AS n, {_key("r[1]")} AS k, {_key("r[2]", "ministerio")} AS m FROM r0),
u AS (SELECT DISTINCT dir3_cod, {_normal("denominacion")} AS un, {_key("denominacion")} AS uk, {_key("ministerio_denominacion", "ministerio")} AS m FROM un),
c AS (SELECT cruce_id, 1 AS rule, dir3_cod FROM r JOIN u ON r.m = u.m AND r.n = u.un UNION ALL SELECT cruce_id, 2, dir3_cod FROM r JOIN u ON r.m = u.m AND r.k = u.uk
  UNION ALL SELECT cruce_id, 3, max(dir3_cod) FROM (SELECT DISTINCT cruce_id, dir3_cod FROM r JOIN u ON r.m = u.m AND r.n <> '' AND starts_with(u.un, r.n)) GROUP BY 1 HAVING count(*) = 1),
x AS (SELECT cruce_id, min((rule, dir3_cod)) AS b FROM c GROUP BY 1)"""
_m = metrics._money
SQL = {
    "e01_anclaje": _ASCENT,
    "e02_destino": f"WITH {model.BRIDGE}, t AS (SELECT dir3_cod, ejercicio, min((seccion_cod, servicio_cod)) AS t FROM br GROUP BY 1, 2) SELECT dir3_cod, ejercicio, t[1] AS seccion_cod, t[2] AS servicio_cod FROM t",
    "e07_cruce": _CROSS + " SELECT cruce_id, b[1] AS regla, b[2] AS dir3_cod FROM x",
    "e08_niveles": f"""WITH {model.UNITS}, n AS (SELECT *, {_normal("denominacion")} AS n FROM un)
SELECT dir3_cod, version_id, coalesce(fecha_inicio, fecha_captura) AS inicio, CASE WHEN estado NOT IN ('V', 'T') THEN coalesce(fecha_fin, fecha_captura) END AS fin,
  CASE {" ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in text.ORGANIC)} WHEN nivel_jerarquico = 1 THEN 'MINISTERIO' ELSE 'OTRO' END AS nivel,
  CASE WHEN {" OR ".join(f"regexp_matches(n, '{p}')" for _, p in text.ORGANIC)} THEN 'denominacion' WHEN nivel_jerarquico = 1 THEN 'profundidad' ELSE 'sin_senal' END AS senal FROM n""",
    "a17_cobertura": _CROSS + ", a AS (SELECT DISTINCT cruce_id FROM crosswalk_servicio_dir3) SELECT coalesce(b[1], 0) AS regla, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM a), 4) AS pct FROM a LEFT JOIN x USING (cruce_id) GROUP BY 1",
    "f01_nombres": f"WITH {model.UNITS} SELECT DISTINCT denominacion, {_normal('denominacion')} AS normal, {_key('denominacion')} AS clave FROM un",
    "f07_beneficiarios": r"""WITH b AS (SELECT DISTINCT concesion_id, concat_ws(' ', beneficiario_nif, beneficiario_nombre) AS b FROM fact_subvenciones),
t AS (SELECT split_part(trim(b), ' ', 1) AS k FROM b), c AS (SELECT k, CASE WHEN regexp_matches(k, '^\*+\w+\*+$|^\d{8}[A-Z]$|^[XYZ]\d{7}[A-Z]$') THEN 'fisica' WHEN regexp_matches(k, '^[A-HJNP-SUVW]\d{7}[0-9A-J]$') THEN 'juridica' END AS tipo FROM t)
SELECT tipo, count(*) AS n, count(*) FILTER (WHERE tipo IS NOT NULL) AS con_nif FROM c GROUP BY 1""",
}
