"""Names brought to units and sections (E-04 to E-07, J-18 to J-21, U-02), with their coverage (A-16, A-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.functions import text
from fiscalspark.plans import model, resolve
from fiscalspark.session import materialise, salted_join
from fiscalspark.sources.tables import table

SERVICE = ["ejercicio", "seccion_cod", "servicio_cod"]
#: Names of services that stand for the top of a ministry, and of one without unit of its own.
GENERAL = r"^ministerio.*(subsecretaria|servicios generales)"
RECOVERY = r"^mecanismo de recuperacion y resiliencia$"
#: Fixed value: departments (normalised) outside the State's administration.
OUTSIDE = r"comunidad autonoma|comunitat valenciana|comunidad foral|administracion local|universidades|otros poderes adjudicadores|otros entes|ciudad de (ceuta|melilla)"
#: Results that no rule can better.
STRUCTURAL = ("seccion_sin_ministerio_dir3", "servicio_instrumental_prtr")


def open_units(spark: SparkSession, d: str) -> DataFrame:
    """Units without end: code, ministry's code, level, normal form (un) and token key (uk) of the name."""
    u = model.units(spark, d).where("fecha_fin IS NULL AND denominacion IS NOT NULL")
    return u.select("dir3_cod", "ministerio_dir3_cod", "nivel_jerarquico", text.normal("denominacion").alias("un"), text.token_key("denominacion").alias("uk")).distinct()


def ministries(spark: SparkSession, d: str, only_open: bool) -> DataFrame:
    """Normal form (mn) of the names of units at the top level, and their code (mc), the smallest of several."""
    u = model.units(spark, d).where("nivel_jerarquico = 1 AND denominacion IS NOT NULL")
    return (u.where("fecha_fin IS NULL") if only_open else u).groupBy(text.normal("denominacion").alias("mn")).agg(F.min("dir3_cod").alias("mc"))


def named_units(asked: DataFrame, units: DataFrame, roots: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """E-04: level2, level3 of asked with dir3_cod and regla ('manual', 'exacta', 'tokens', 'unica_global'); both null if no rule holds.

    A fixed name goes first (overrides: name, dir3_cod), then the same name within the ministry that level2 names, then the same
    words there (smallest code of several), then a name that only one unit anywhere has. Each rule is an equi-join with one
    row a key; distinct pairs are resolved once. Null and empty names find nothing.
    """
    a = asked.select("level2", "level3").distinct().withColumn("n", text.normal("level3")).withColumn("k", text.token_key("level3")).withColumn("mn", text.normal("level2")).where("n <> ''")
    inside = units.where("ministerio_dir3_cod IS NOT NULL")
    a = salted_join(a, roots, ["mn"], "left")
    a = salted_join(a, inside.groupBy(F.col("ministerio_dir3_cod").alias("mc"), F.col("un").alias("n")).agg(F.min("dir3_cod").alias("exact")), ["mc", "n"], "left")
    a = salted_join(a, inside.groupBy(F.col("ministerio_dir3_cod").alias("mc"), F.col("uk").alias("k")).agg(F.min("dir3_cod").alias("tokens")), ["mc", "k"], "left")
    alone = units.groupBy(F.col("un").alias("n")).agg(F.min("dir3_cod").alias("alone"), F.max("dir3_cod").alias("hi")).where("alone = hi").drop("hi")
    a = salted_join(a, alone, ["n"], "left")
    if overrides is None:
        a = a.withColumn("fixed", F.lit(None).cast("string"))
    else:
        a = salted_join(a, overrides.groupBy(text.normal("name").alias("n")).agg(F.min("dir3_cod").alias("fixed")), ["n"], "left")
    rule = F.when(F.col("fixed").isNotNull(), "manual").when(F.col("exact").isNotNull(), "exacta").when(F.col("tokens").isNotNull(), "tokens").when(F.col("alone").isNotNull(), "unica_global")
    return a.select("level2", "level3", F.coalesce("fixed", "exact", "tokens", "alone").alias("dir3_cod"), rule.alias("regla"))


def granting_bodies(spark: SparkSession, d: str) -> DataFrame:
    """E-04 over the bodies of the State's grants: each pair of names with its unit and rule."""
    g = table(spark, d, "fact_subvenciones").where(text.normal("nivel1") == "estado").select(F.col("nivel2").alias("level2"), F.col("nivel3").alias("level3"))
    return named_units(g, open_units(spark, d), ministries(spark, d, False)).select(F.col("level2").alias("nivel2"), F.col("level3").alias("nivel3"), "dir3_cod", "regla")


def grant_anchors(spark: SparkSession, d: str) -> DataFrame:
    """E-05: anchor of every grant: 'no_estatal' outside the State, 'organo_no_resuelto' without unit, else that of its unit (E-01)
    on the grant's day, else its registration's, in the year of the period."""
    rows = table(spark, d, "fact_subvenciones").groupBy("concesion_id").agg(F.max(F.struct(F.coalesce("fecha_concesion", "fecha_alta").alias("day"), F.substring("periodo", 1, 4).cast("int").alias("year"), "nivel1", "nivel2", "nivel3")).alias("r"))
    rows = rows.select(F.col("concesion_id").alias("id"), "r.day", "r.year", "r.nivel1", F.col("r.nivel2").alias("level2"), F.col("r.nivel3").alias("level3"))
    state = text.normal("nivel1") == "estado"
    bodies = materialise(named_units(rows.where(state), open_units(spark, d), ministries(spark, d, False)).where("dir3_cod IS NOT NULL").select("level2", "level3", F.col("dir3_cod").alias("code")))
    coded = rows.withColumn("state", state)
    coded = coded.join(bodies, coded["level2"].eqNullSafe(bodies["level2"]) & (coded["level3"] == bodies["level3"]), "left").drop(bodies["level2"]).drop(bodies["level3"])
    done = resolve.anchored(coded.select("id", F.when(F.col("state"), F.col("code")).alias("code"), "day", "year"), spark, d)
    j = coded.select("id", "state", "code").join(done, "id")
    kind = F.when(~F.col("state"), "fuera_perimetro").when(F.col("code").isNull(), "sin_anclar").otherwise(F.col("anclaje_tipo"))
    signal = F.when(~F.col("state"), "no_estatal").when(F.col("code").isNull(), "organo_no_resuelto").otherwise(F.col("anclaje_senal"))
    return j.select(F.col("id").alias("concesion_id"), "seccion_cod", "servicio_cod", "anclaje_dir3_cod", kind.alias("anclaje_tipo"), signal.alias("anclaje_senal"))


def sections_by_name(spark: SparkSession, d: str, history: DataFrame | None = None) -> DataFrame:
    """Token keys (k) of the names of sections by year (y) with the first and last section (lo, hi) of that name; history brings
    names of other years (ejercicio, denominacion, seccion_cod)."""
    s = model.services(spark, d).select("ejercicio", F.col("seccion_denominacion").alias("denominacion"), "seccion_cod")
    if history is not None:
        s = s.unionByName(history.select("ejercicio", "denominacion", "seccion_cod"))
    keyed = s.where("denominacion IS NOT NULL AND seccion_cod IS NOT NULL").select(F.col("ejercicio").alias("y"), text.token_key("denominacion", "ministerio").alias("k"), "seccion_cod")
    return keyed.where("k <> ''").groupBy("y", "k").agg(F.min("seccion_cod").alias("lo"), F.max("seccion_cod").alias("hi"))


def section_anchors(asked: DataFrame, index: DataFrame) -> DataFrame:
    """E-06: ministerio, ejercicio of asked with section, kind and signal: the structure of the year, else of the last year before
    it, else of the first. A name that several sections have is not anchored. Null and blank names are 'sin_ministerio'."""
    ys = index.agg(F.array_sort(F.collect_set("y")).alias("ys")).withColumn("u", F.lit(1))
    a = asked.select("ministerio", "ejercicio").distinct().withColumn("n", text.normal("ministerio")).withColumn("k", text.token_key("ministerio", "ministerio")).withColumn("u", F.lit(1)).join(F.broadcast(ys), "u")
    before = F.filter("ys", lambda y: y <= F.col("ejercicio"))
    a = a.withColumn("y", F.when(F.size(before) > 0, F.element_at(before, -1)).otherwise(F.get("ys", F.lit(0)))).drop("u", "ys")
    j = a.join(F.broadcast(index), ["y", "k"], "left")
    outside, one, many = F.col("n").rlike(OUTSIDE), F.col("lo") == F.col("hi"), F.col("lo") < F.col("hi")
    none = F.col("n") == ""
    kind = F.when(none, "sin_anclar").when(outside, "fuera_perimetro").when(one, "seccion").otherwise("sin_anclar")
    signal = F.when(none, "sin_ministerio").when(outside, "departamento_no_age").when(one, "ministerio_denominacion").when(many, "ministerio_ambiguo").otherwise("ministerio_no_mapeable")
    return j.select("ministerio", "ejercicio", F.when(kind == "seccion", F.col("lo")).alias("seccion_cod"), kind.alias("anclaje_tipo"), signal.alias("anclaje_senal"))


def manual_pairs(spark: SparkSession, d: str) -> DataFrame:
    """U-02: pairs of service and unit that were set by hand, from the crosswalk's rows marked so."""
    rows = table(spark, d, "crosswalk_servicio_dir3").where("match_tipo = 'manual' AND dir3_cod IS NOT NULL")
    return rows.select("ejercicio", model.two("seccion_cod").alias("seccion_cod"), model.two("servicio_cod").alias("servicio_cod"), F.upper(F.trim("dir3_cod")).alias("dir3_cod")).distinct()


def unusable_pairs(pairs: DataFrame, services: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs set by hand whose service or unit does not exist, with the reason; a load refuses them."""
    s = services.select(*SERVICE).distinct().withColumn("has_service", F.lit(True))
    u = units.select("dir3_cod").distinct().withColumn("has_unit", F.lit(True))
    why = F.when(F.col("has_service").isNull(), "servicio_inexistente").when(F.col("has_unit").isNull(), "unidad_inexistente")
    return pairs.join(s, SERVICE, "left").join(u, "dir3_cod", "left").withColumn("motivo", why).where("motivo IS NOT NULL").select(*pairs.columns, "motivo")


def service_units(services: DataFrame, units: DataFrame, roots: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """E-07: ejercicio, seccion_cod, servicio_cod, dir3_cod, match_tipo, match_detalle, a row for each unit of a service, one with null
    unit for a service that has none.

    Within the ministry of the section: the same name, the same words, the only name that begins so (the last word may go on),
    the ministry and its under-secretariat for general services; the first rule that finds any gives all it finds. Pairs
    set by hand replace what the rules found (J-21). Candidates are equi-joins; those of the prefix rule meet by all words but
    the last, so they do not grow with names that merely begin alike.
    """
    s = services.select(*SERVICE, text.normal("seccion_denominacion").alias("mn"), text.normal("servicio_denominacion").alias("n"), text.token_key("servicio_denominacion").alias("k"))
    s = s.join(F.broadcast(roots), "mn", "left").drop("mn")
    inside = units.where("ministerio_dir3_cod IS NOT NULL").withColumnRenamed("ministerio_dir3_cod", "mc")
    key = [*SERVICE]
    same = s.join(inside.withColumn("n", F.col("un")), ["mc", "n"]).select(*key, F.lit(1).alias("rule"), "dir3_cod")
    words = s.join(inside.withColumn("k", F.col("uk")), ["mc", "k"]).select(*key, F.lit(2).alias("rule"), "dir3_cod")
    w = F.split("n", " ")
    asked = s.where("mc IS NOT NULL AND n <> ''").withColumn("f", F.array_join(F.slice(w, 1, F.size(w) - 1), " "))
    uw = F.split("un", " ")
    fronts = inside.withColumn("j", F.explode(F.sequence(F.lit(0), F.size(uw) - 1))).withColumn("f", F.array_join(F.slice(uw, F.lit(1), F.col("j")), " ")).drop("j")
    begun = asked.join(fronts, ["mc", "f"]).where("startswith(un, n)").select(*key, "dir3_cod").distinct()
    front = begun.groupBy(*key).agg(F.min("dir3_cod").alias("dir3_cod"), F.max("dir3_cod").alias("hi")).where("dir3_cod = hi").select(*key, F.lit(3).alias("rule"), "dir3_cod")
    top = inside.where("dir3_cod = mc OR (startswith(un, 'subsecretaria') AND nivel_jerarquico = 2)").select("mc", "dir3_cod").distinct()
    general = s.where(F.col("n").rlike(GENERAL)).join(top, "mc").select(*key, F.lit(4).alias("rule"), "dir3_cod")
    found = same.unionByName(words).unionByName(front).unionByName(general).distinct()
    first = F.min("rule").over(Window.partitionBy(*key))
    found = found.withColumn("first", first).where("rule = first").drop("first")
    j = s.join(found, key, "left")
    kinds = {1: ("exacto", "denominacion_normalizada"), 2: ("por_denominacion", "tokens_significativos"), 3: ("por_denominacion", "prefijo_unico"), 4: ("por_denominacion", "regla_servicios_generales")}
    pick = lambda i: F.coalesce(*[F.when(F.col("rule") == k, v[i]) for k, v in kinds.items()])
    none = F.when(F.col("mc").isNull(), STRUCTURAL[0]).when(F.col("n").rlike(RECOVERY), STRUCTURAL[1]).otherwise("sin_candidato_en_subarbol")
    auto = j.select(*key, "dir3_cod", F.coalesce(pick(0), F.lit("sin_match")).alias("match_tipo"), F.coalesce(pick(1), none).alias("match_detalle"))
    if manual is None:
        return auto
    good = manual.join(services.select(*key).distinct(), key, "left_semi").join(units.select("dir3_cod").distinct(), "dir3_cod", "left_semi")
    fixed = good.select(*key, "dir3_cod", F.lit("manual").alias("match_tipo"), F.lit("override").alias("match_detalle")).distinct()
    return auto.join(fixed.select(*key), key, "left_anti").unionByName(fixed)


def crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """E-07 over the services of all years and the pairs set by hand."""
    return service_units(model.services(spark, d), open_units(spark, d), ministries(spark, d, True), manual_pairs(spark, d))


def crosswalk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A-17: services, those without match for structural reasons, and the percentages without match: of all services, and of those that could have one."""
    one = crosswalk(spark, d).groupBy(*SERVICE).agg(F.min(F.struct("match_tipo", "match_detalle")).alias("m"))
    t = one.agg(F.count("*").alias("servicios"), F.count_if(F.col("m.match_detalle").isin(*STRUCTURAL)).alias("sin_match_estructural"), F.count_if(F.col("m.match_tipo") == "sin_match").alias("sin"))
    pct = lambda a, b: F.round(F.try_divide(100.0 * a, b), 4)
    return t.select("servicios", "sin_match_estructural", pct(F.col("sin"), F.col("servicios")).alias("sin_match_pct"), pct(F.col("sin") - F.col("sin_match_estructural"), F.col("servicios") - F.col("sin_match_estructural")).alias("sin_candidato_pct"))


def anchor_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A-16: tenders by the kind of their first lot's anchor, with percentages, so that tenders of many lots do not weigh more."""
    one = model.contracts(spark, d).groupBy("licitacion_id").agg(F.min(F.struct("lote_id", "anclaje_tipo")).alias("a"))
    n = one.groupBy(F.col("a.anclaje_tipo").alias("anclaje_tipo")).agg(F.count("*").alias("n"))
    total = one.agg(F.count("*").alias("t")).withColumn("u", F.lit(1))
    return n.withColumn("u", F.lit(1)).join(F.broadcast(total), "u").select("anclaje_tipo", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))


QUERIES = {"e04_organos": granting_bodies, "e05_anclaje_subvenciones": grant_anchors, "e07_servicio_unidad": crosswalk, "a16_cobertura_contratos": anchor_coverage, "a17_cobertura_servicios": crosswalk_coverage}

_n, _k = resolve._normal, resolve._key
_OPEN = f"ou AS (SELECT DISTINCT dir3_cod, ministerio_dir3_cod, nivel_jerarquico, {_n('denominacion')} AS un, {_k('denominacion')} AS uk FROM un WHERE fecha_fin IS NULL AND denominacion IS NOT NULL)"
_ROOTS = f"rt AS (SELECT {_n('denominacion')} AS mn, min(dir3_cod) AS mc FROM un WHERE nivel_jerarquico = 1 AND denominacion IS NOT NULL GROUP BY 1)"
_BODIES = f"""{model.UNITS}, {_OPEN}, {_ROOTS}, gp AS (SELECT DISTINCT nivel2, nivel3, {_n("nivel3")} AS n, {_k("nivel3")} AS k, {_n("nivel2")} AS mn FROM fact_subvenciones WHERE {_n("nivel1")} = 'estado' AND {_n("nivel3")} <> ''),
gq AS (SELECT gp.*, rt.mc FROM gp LEFT JOIN rt USING (mn)),
gx AS (SELECT gq.*, (SELECT min(dir3_cod) FROM ou WHERE ou.ministerio_dir3_cod = gq.mc AND ou.un = gq.n) AS x1, (SELECT min(dir3_cod) FROM ou WHERE ou.ministerio_dir3_cod = gq.mc AND ou.uk = gq.k) AS x2,
  (SELECT CASE WHEN count(DISTINCT dir3_cod) = 1 THEN min(dir3_cod) END FROM ou WHERE ou.un = gq.n) AS x3 FROM gq),
bo AS (SELECT nivel2, nivel3, coalesce(x1, x2, x3) AS dir3_cod, CASE WHEN x1 IS NOT NULL THEN 'exacta' WHEN x2 IS NOT NULL THEN 'tokens' WHEN x3 IS NOT NULL THEN 'unica_global' END AS regla FROM gx)"""
_GRANT = f"""{_BODIES.replace(model.UNITS + ", ", "")}, r0 AS (SELECT concesion_id, max((coalesce(fecha_concesion, fecha_alta), CAST(left(periodo, 4) AS INT), nivel1, nivel2, nivel3)) AS x FROM fact_subvenciones GROUP BY 1),
r1 AS (SELECT concesion_id, x[1] AS day, x[2] AS year, {_n("x[3]")} = 'estado' AS state, x[4] AS n2, x[5] AS n3 FROM r0),
rq AS (SELECT r1.concesion_id AS id, r1.day, CASE WHEN r1.state THEN bo.dir3_cod END AS code, r1.year, r1.state FROM r1 LEFT JOIN bo ON bo.nivel2 IS NOT DISTINCT FROM r1.n2 AND bo.nivel3 = r1.n3)"""
_SERVICES = f"""{model.SERVICES}, {model.UNITS}, {_OPEN}, ro AS (SELECT {_n("denominacion")} AS mn, min(dir3_cod) AS mc FROM un WHERE nivel_jerarquico = 1 AND denominacion IS NOT NULL AND fecha_fin IS NULL GROUP BY 1),
ss AS (SELECT ejercicio, seccion_cod, servicio_cod, {_n("seccion_denominacion")} AS mn, {_n("servicio_denominacion")} AS n, {_k("servicio_denominacion")} AS k FROM sv), s AS (SELECT ss.*, ro.mc FROM ss LEFT JOIN ro USING (mn)),
c AS (SELECT ejercicio, seccion_cod, servicio_cod, 1 AS rule, dir3_cod FROM s JOIN ou ON ou.ministerio_dir3_cod = s.mc AND ou.un = s.n
  UNION SELECT ejercicio, seccion_cod, servicio_cod, 2, dir3_cod FROM s JOIN ou ON ou.ministerio_dir3_cod = s.mc AND ou.uk = s.k
  UNION SELECT ejercicio, seccion_cod, servicio_cod, 3, min(dir3_cod) FROM s JOIN ou ON ou.ministerio_dir3_cod = s.mc AND s.n <> '' AND starts_with(ou.un, s.n) GROUP BY 1, 2, 3 HAVING count(DISTINCT dir3_cod) = 1
  UNION SELECT ejercicio, seccion_cod, servicio_cod, 4, dir3_cod FROM s JOIN ou ON ou.ministerio_dir3_cod = s.mc AND regexp_matches(s.n, '{GENERAL}') AND (ou.dir3_cod = s.mc OR (starts_with(ou.un, 'subsecretaria') AND ou.nivel_jerarquico = 2))),
b AS (SELECT * FROM c QUALIFY rule = min(rule) OVER (PARTITION BY ejercicio, seccion_cod, servicio_cod)),
au AS (SELECT s.ejercicio, s.seccion_cod, s.servicio_cod, b.dir3_cod, CASE b.rule WHEN 1 THEN 'exacto' WHEN 2 THEN 'por_denominacion' WHEN 3 THEN 'por_denominacion' WHEN 4 THEN 'por_denominacion' ELSE 'sin_match' END AS match_tipo,
  CASE b.rule WHEN 1 THEN 'denominacion_normalizada' WHEN 2 THEN 'tokens_significativos' WHEN 3 THEN 'prefijo_unico' WHEN 4 THEN 'regla_servicios_generales' ELSE CASE WHEN s.mc IS NULL THEN '{STRUCTURAL[0]}' WHEN regexp_matches(s.n, '{RECOVERY}') THEN '{STRUCTURAL[1]}' ELSE 'sin_candidato_en_subarbol' END END AS match_detalle
  FROM s LEFT JOIN b USING (ejercicio, seccion_cod, servicio_cod)),
ma AS (SELECT DISTINCT ejercicio, {model._two("seccion_cod")} AS seccion_cod, {model._two("servicio_cod")} AS servicio_cod, upper(trim(dir3_cod)) AS dir3_cod FROM crosswalk_servicio_dir3 WHERE match_tipo = 'manual' AND dir3_cod IS NOT NULL),
mg AS (SELECT ma.*, 'manual' AS match_tipo, 'override' AS match_detalle FROM ma SEMI JOIN sv USING (ejercicio, seccion_cod, servicio_cod) WHERE dir3_cod IN (SELECT dir3_cod FROM ou)),
xw AS (SELECT * FROM au ANTI JOIN mg USING (ejercicio, seccion_cod, servicio_cod) UNION ALL SELECT * FROM mg)"""
SQL = {
    "e04_organos": f"WITH {_BODIES} SELECT * FROM bo",
    "e05_anclaje_subvenciones": f"""WITH RECURSIVE {model.UNITS}, {model.BRIDGE}, {_GRANT}, {resolve._CLIMB}
SELECT rq.id AS concesion_id, an.seccion_cod, an.servicio_cod, CASE WHEN rq.state AND rq.code IS NOT NULL THEN an.anclaje_dir3_cod END AS anclaje_dir3_cod, CASE WHEN NOT rq.state THEN 'fuera_perimetro' WHEN rq.code IS NULL THEN 'sin_anclar' ELSE an.anclaje_tipo END AS anclaje_tipo,
  CASE WHEN NOT rq.state THEN 'no_estatal' WHEN rq.code IS NULL THEN 'organo_no_resuelto' ELSE an.anclaje_senal END AS anclaje_senal FROM rq JOIN an ON an.id = rq.id""",
    "e07_servicio_unidad": f"WITH {_SERVICES} SELECT * FROM xw",
    "a16_cobertura_contratos": f"WITH {model.CONTRACTS}, o AS (SELECT licitacion_id, min((lote_id, anclaje_tipo)) AS a FROM ct GROUP BY 1) SELECT a[2] AS anclaje_tipo, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM o), 4) AS pct FROM o GROUP BY 1",
    "a17_cobertura_servicios": f"""WITH {_SERVICES}, o AS (SELECT min((match_tipo, match_detalle)) AS m FROM xw GROUP BY ejercicio, seccion_cod, servicio_cod),
t AS (SELECT count(*) AS servicios, count(*) FILTER (WHERE m[2] IN {STRUCTURAL}) AS sin_match_estructural, count(*) FILTER (WHERE m[1] = 'sin_match') AS sin FROM o)
SELECT servicios, sin_match_estructural, round(100.0 * sin / nullif(servicios, 0), 4) AS sin_match_pct, round(100.0 * (sin - sin_match_estructural) / nullif(servicios - sin_match_estructural, 0), 4) AS sin_candidato_pct FROM t""",
}
