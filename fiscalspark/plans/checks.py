"""Accounting checks (C-R1 to C-R8, C-ENG): each gives its violations, or every group with the figures compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.operators.measures import money
from fiscalspark.plans import metrics, model, views
from fiscalspark.session import materialise, salted_join

#: Tolerances in euros at service, section and grand total.
TOLERANCE = {"servicio": 0.5, "seccion": 5.0, "age": 50.0}
LABEL = ["seccion_cod", "servicio_cod"]


def exposure(spark: SparkSession, d: str) -> DataFrame:
    """R1: rows and amounts by section, in the facts and through the joined view; both sides summed, then a full join."""
    side = lambda df, p: df.groupBy("seccion_cod").agg(F.count("*").alias(f"n_{p}"), money("orn").alias(f"orn_{p}"))
    a, b = side(model.execution(spark, d), "hechos"), side(views.execution_view(spark, d), "vista")
    j = a.join(b, "seccion_cod", "full").na.fill(0)
    bad = (F.col("n_hechos") != F.col("n_vista")) | (F.abs(F.col("orn_hechos") - F.col("orn_vista")) > TOLERANCE["seccion"])
    return j.withColumn("falla", F.when(bad, 1).otherwise(0))


def total_exposure(spark: SparkSession, d: str) -> DataFrame:
    """R2: the same for the grand total, from the sums by section."""
    t = exposure(spark, d).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_hechos", "n_vista")], money("orn_hechos").alias("orn_hechos"), money("orn_vista").alias("orn_vista"))
    return t.withColumn("falla", F.when((F.col("n_hechos") != F.col("n_vista")) | (F.abs(F.col("orn_hechos") - F.col("orn_vista")) > TOLERANCE["age"]), 1).otherwise(0))


def within_credit(level: str):
    """R3: groups and months with more obligations than final appropriation; groups without final amount are not comparable."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        s = metrics.sums(spark, d, level, F.lit(True))
        return s.where(F.col("orn") > F.col("credito_definitivo") + TOLERANCE[level]).select(*metrics.LEVELS[level], "periodo", "orn", "credito_definitivo")

    return query


def derived_modifications(spark: SparkSession, d: str) -> DataFrame:
    """R4a: net modification of each month and the number of sections where it is negative."""
    m = F.round(F.col("credito_definitivo") - F.col("credito_inicial"), 2)
    s = metrics.sums(spark, d, "seccion", F.lit(True)).withColumn("m", m)
    return s.groupBy("periodo").agg(money("m").alias("neta"), F.count_if(F.col("m") < 0).alias("secciones_negativas"))


def covers(c: str):
    return F.array_contains(F.split("cobertura", ","), c)


def explicit_modifications(spark: SparkSession, d: str) -> DataFrame:
    """R4b: services and months whose final appropriation is not the initial one plus the modifications, over complete rows
    of sources that cover them."""
    rows = model.execution(spark, d).where(covers("modificaciones") & F.col("credito_inicial").isNotNull() & F.col("credito_definitivo").isNotNull() & F.col("modificaciones").isNotNull())
    s = rows.groupBy(*LABEL, "periodo").agg(money(F.col("credito_definitivo") - F.col("credito_inicial") - F.col("modificaciones")).alias("diferencia"))
    return s.where(F.abs("diferencia") > TOLERANCE["servicio"])


def payments(spark: SparkSession, d: str) -> DataFrame:
    """R5: services and months with more payments than obligations, where a source covers payments."""
    s = model.execution(spark, d).where(covers("pagos")).groupBy(*LABEL, "periodo").agg(money("pagos").alias("pagos"), money("orn").alias("orn"))
    return s.where(F.col("pagos") > F.col("orn") + TOLERANCE["servicio"])


def unnamed(spark: SparkSession, d: str) -> DataFrame:
    """R6: services of the execution that no named row of the dimension knows, with their rows."""
    named = model.services(spark, d).where("servicio_denominacion IS NOT NULL").select("ejercicio", *LABEL)
    return model.execution(spark, d).join(named, ["ejercicio", *LABEL], "left_anti").groupBy("ejercicio", *LABEL).agg(F.count("*").alias("n"))


def negative(spark: SparkSession, d: str) -> DataFrame:
    """R7: rows with negative initial appropriation or obligations, and services with negative final appropriation, by month."""
    e = model.execution(spark, d)
    rows = e.groupBy("periodo").agg(F.count_if(F.col("credito_inicial") < 0).alias("inicial"), F.count_if(F.col("orn") < 0).alias("orn"))
    pool = e.groupBy("periodo", *LABEL).agg(money("credito_definitivo").alias("f")).groupBy("periodo").agg(F.count_if(F.col("f") < 0).alias("definitivo"))
    return rows.join(pool, "periodo")


def continuity(spark: SparkSession, d: str) -> DataFrame:
    """R8: services whose obligations fall, whose initial appropriation changes or which vanish, against the month loaded before."""
    s = metrics.sums(spark, d, "servicio", F.lit(True)).withColumn("ejercicio", F.substring("periodo", 1, 4).cast("int")).select("ejercicio", "periodo", *LABEL, "credito_inicial", "orn")
    months = s.select("ejercicio", "periodo").distinct()
    nxt = months.withColumn("siguiente", F.lead("periodo").over(Window.partitionBy("ejercicio").orderBy("periodo"))).where("siguiente IS NOT NULL")
    before = s.join(F.broadcast(nxt), ["ejercicio", "periodo"]).select(F.col("siguiente").alias("periodo"), *LABEL, F.col("credito_inicial").alias("inicial_prev"), F.col("orn").alias("orn_prev"))
    j = before.join(s, ["periodo", *LABEL], "left")
    why = F.when(F.col("ejercicio").isNull(), "desaparece").when(F.col("orn") < F.col("orn_prev") - TOLERANCE["servicio"], "orn_decrece").when(F.abs(F.col("credito_inicial") - F.col("inicial_prev")) > TOLERANCE["servicio"], "inicial_cambia")
    return j.withColumn("motivo", why).where("motivo IS NOT NULL").select("periodo", *LABEL, "motivo")


#: Rule, scope, magnitudes that it needs.
RULES = [
    ("R1", "seccion", ()), ("R2", "AGE", ()), ("R3", "AGE", ("credito_definitivo", "orn")), ("R3", "seccion", ("credito_definitivo", "orn")), ("R3", "servicio", ("credito_definitivo", "orn")), ("R4", "derivada", ("credito_definitivo", "credito_inicial")),
    ("R4", "explicita", ("credito_definitivo", "credito_inicial", "modificaciones")), ("R5", "servicio", ("orn", "pagos")), ("R6", "ancla", ()), ("R7", "inicial", ("credito_inicial",)), ("R7", "orn", ("orn",)), ("R7", "definitivo", ("credito_definitivo",)), ("R8", "servicio", ("orn",)),
]
RESULT = ["regla", "ambito", "periodo", "estado", "descuadres", "motivo"]
#: Violations that a result lists, and those that are shown of them.
LISTED, SHOWN = 20, 3


def pools(spark: SparkSession, d: str, only: list[str] | None = None) -> DataFrame:
    """All that the rules ask of the facts, by period, section and service, from one pass over them: rows, sums, rows of negative amounts,
    and whether the dimension knows and names the service."""
    e = model.execution(spark, d)
    if only is not None:
        e = e.where(F.substring("periodo", 1, 4).isin(*sorted({p[:4] for p in only})))
    return pools_of(e, model.services(spark, d))


def pools_of(e: DataFrame, services: DataFrame) -> DataFrame:
    """pools of any frames of execution and services."""
    full = covers("modificaciones") & F.col("credito_inicial").isNotNull() & F.col("credito_definitivo").isNotNull() & F.col("modificaciones").isNotNull()
    g = e.groupBy("periodo", "ejercicio", *LABEL).agg(
        F.count("*").alias("n"), *[money(c).alias(c) for c in ("credito_inicial", "credito_definitivo", "orn")], money(F.when(full, F.col("credito_definitivo") - F.col("credito_inicial") - F.col("modificaciones"))).alias("resto"),
        money(F.when(covers("pagos"), F.col("pagos"))).alias("pagos"), money(F.when(covers("pagos"), F.col("orn"))).alias("orn_pagos"), F.count_if(F.col("credito_inicial") < 0).alias("neg_inicial"), F.count_if(F.col("orn") < 0).alias("neg_orn"),
        F.array_distinct(F.flatten(F.collect_set(F.split("cobertura", ",")))).alias("cubre"),
    )
    s = services.groupBy("ejercicio", *LABEL).agg(F.lit(True).alias("conocido"), F.max(F.col("servicio_denominacion").isNotNull()).alias("nombrado"))
    return materialise(salted_join(g, s, ["ejercicio", *LABEL], "left").na.fill(False, ["conocido", "nombrado"]))


def violations_of(g: DataFrame) -> dict[tuple[str, str], DataFrame]:
    """Groups that break each rule, with their period."""
    seen = lambda c: F.when(F.col("conocido"), F.col(c))

    def exposed(by: list[str], tol: float) -> DataFrame:
        t = g.groupBy("periodo", *by).agg(F.sum("n").alias("n_hechos"), F.sum(F.when(F.col("conocido"), F.col("n")).otherwise(0)).alias("n_vista"), F.coalesce(money("orn"), F.lit(0.0)).alias("orn_hechos"), F.coalesce(money(seen("orn")), F.lit(0.0)).alias("orn_vista"))
        return t.where((F.col("n_hechos") != F.col("n_vista")) | (F.abs(F.col("orn_hechos") - F.col("orn_vista")) > tol))

    def over(level: str) -> DataFrame:
        t = g.groupBy("periodo", *metrics.LEVELS[level]).agg(money("orn").alias("orn"), money("credito_definitivo").alias("credito_definitivo"))
        return t.where(F.col("orn") > F.col("credito_definitivo") + TOLERANCE[level])

    months = g.select("ejercicio", "periodo").distinct().withColumn("siguiente", F.lead("periodo").over(Window.partitionBy("ejercicio").orderBy("periodo"))).where("siguiente IS NOT NULL")
    before = g.join(F.broadcast(months), ["ejercicio", "periodo"]).select(F.col("siguiente").alias("periodo"), *LABEL, F.col("credito_inicial").alias("inicial_prev"), F.col("orn").alias("orn_prev"))
    now = g.select("periodo", *LABEL, F.col("credito_inicial").alias("inicial"), "orn", F.lit(True).alias("esta"))
    j = before.join(now, ["periodo", *LABEL], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fell = zero("orn_prev") - zero("orn") > TOLERANCE["servicio"]
    return {
        ("R1", "seccion"): exposed(["seccion_cod"], TOLERANCE["seccion"]), ("R2", "AGE"): exposed([], TOLERANCE["age"]), ("R3", "AGE"): over("age"), ("R3", "seccion"): over("seccion"), ("R3", "servicio"): over("servicio"),
        ("R4", "explicita"): g.where(F.abs("resto") > TOLERANCE["servicio"]).select("periodo", *LABEL, "resto"), ("R5", "servicio"): g.where(F.col("pagos") > F.col("orn_pagos") + TOLERANCE["servicio"]).select("periodo", *LABEL, "pagos", "orn_pagos"),
        ("R6", "ancla"): g.where("NOT nombrado").select("periodo", *LABEL, "n"), ("R7", "inicial"): g.where("neg_inicial > 0").select("periodo", *LABEL, F.col("neg_inicial").alias("filas")), ("R7", "orn"): g.where("neg_orn > 0").select("periodo", *LABEL, F.col("neg_orn").alias("filas")),
        ("R7", "definitivo"): g.where(F.col("credito_definitivo") < -TOLERANCE["servicio"]).select("periodo", *LABEL, "credito_definitivo"),
        ("R8", "servicio"): j.where(F.col("esta").isNull() | fell | (F.abs(F.col("inicial_prev") - F.col("inicial")) > TOLERANCE["servicio"])).select("periodo", *LABEL, "orn_prev", "orn", "inicial_prev", "inicial"),
    }


def engine(only: list[str] | None = None):
    """C-ENG: each rule and scope of each period: PASS, FAIL with the number of violations, or SKIPPED with the reason: no source of the period
    covers a magnitude that the rule needs, or there is no earlier month in the year. A negative row counts as a row (R7)."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return judged(pools(spark, d, only), only)

    return query


def judged(g: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The engine over pools."""
    p = g.groupBy("periodo", "ejercicio").agg(F.array_distinct(F.flatten(F.collect_set("cubre"))).alias("cubre")).withColumn("primero", F.row_number().over(Window.partitionBy("ejercicio").orderBy("periodo")) == 1)
    found = violations_of(g)
    counts = reduce(DataFrame.unionByName, [v.groupBy("periodo").agg((F.sum("filas") if "filas" in v.columns else F.count("*")).cast("long").alias("k")).select(F.lit(r).alias("regla"), F.lit(a).alias("ambito"), "periodo", "k") for (r, a), v in found.items()])
    every = F.array(*[F.struct(F.lit(r).alias("regla"), F.lit(a).alias("ambito"), F.array(*[F.lit(x) for x in need]).cast("array<string>").alias("pide")) for r, a, need in RULES])
    e = p.select("periodo", "cubre", "primero", F.explode(every).alias("r")).select("periodo", "cubre", "primero", "r.*").join(F.broadcast(counts), ["regla", "ambito", "periodo"], "left")
    lacks = F.array_sort(F.array_except("pide", "cubre"))
    first = (F.col("regla") == "R8") & F.col("primero")
    state = F.when((F.size(lacks) > 0) | first, "SKIPPED").when(F.col("k") > 0, "FAIL").otherwise("PASS")
    why = F.when(F.size(lacks) > 0, F.concat(F.lit("sin "), F.array_join(lacks, ", "))).when(first, "primer periodo del ejercicio")
    out = e.select("regla", "ambito", "periodo", state.alias("estado"), F.when(state == "FAIL", F.col("k")).otherwise(0).cast("long").alias("descuadres"), why.alias("motivo"))
    return out if only is None else out.where(F.col("periodo").isin(*only))


def run_checks(spark: SparkSession, d: str, only: list[str] | None = None) -> DataFrame:
    """The engine over the periods named, or all. A period that is not loaded is an error (U-04)."""
    if only is not None:
        asked = spark.createDataFrame([(p,) for p in only], "periodo string")
        unknown = [r.periodo for r in asked.join(model.execution(spark, d).select("periodo").distinct(), "periodo", "left_anti").collect()]
        if unknown:
            raise ValueError(f"not loaded: {', '.join(sorted(unknown))}")
    return engine(only)(spark, d)


def listed(spark: SparkSession, d: str, rule: str, scope: str, period: str) -> list[dict]:
    """O-08: the first violations of a rule in a period, by section and service; a report shows SHOWN of them and counts the rest."""
    rows = violations_of(pools(spark, d, [period]))[rule, scope].where(F.col("periodo") == period)
    return [r.asDict() for r in rows.orderBy(*[c for c in LABEL if c in rows.columns]).limit(LISTED).collect()]


def summary(results: list[dict]) -> dict[str, int]:
    """A-19: results by state."""
    return {state: sum(r["estado"] == state for r in results) for state in ("PASS", "FAIL", "SKIPPED")}


def as_text(results: list[dict]) -> str:
    """K-20: the results for a person, with a last line of sums."""
    lines = [f"{r['estado']:<7} {r['regla']:<3} {r['periodo']}  {r['ambito']}" + (f" ({r['descuadres']})" if r["descuadres"] else "") + (f" — {r['motivo']}" if r["motivo"] else "") for r in results]
    return "\n".join([*lines, "Resumen: " + ", ".join(f"{n} {k}" for k, n in summary(results).items())])


QUERIES = {
    "cr1_exposicion": exposure, "cr2_total": total_exposure, **{f"cr3_credito_{x}": within_credit(x) for x in TOLERANCE}, "cr4a_modificaciones": derived_modifications, "cr4b_explicitas": explicit_modifications,
    "cr5_pagos": payments, "cr6_huerfanos": unnamed, "cr7_negativos": negative, "cr8_continuidad": continuity, "ceng_reglas": engine(), "ceng_periodo": engine([metrics.MONTH]),
}

_m = metrics._money
_R1 = f"""WITH {views.EXECUTION_VIEW}, a AS (SELECT seccion_cod, count(*) AS n, {_m("orn")} AS orn FROM ej GROUP BY 1), b AS (SELECT seccion_cod, count(*) AS n, {_m("orn")} AS orn FROM vej GROUP BY 1),
r1 AS (SELECT seccion_cod, coalesce(a.n, 0) AS n_hechos, coalesce(b.n, 0) AS n_vista, coalesce(a.orn, 0) AS orn_hechos, coalesce(b.orn, 0) AS orn_vista FROM a FULL JOIN b USING (seccion_cod)),
r1f AS (SELECT *, CASE WHEN n_hechos <> n_vista OR abs(orn_hechos - orn_vista) > 5 THEN 1 ELSE 0 END AS falla FROM r1)"""
_R4B = f"""WITH {model.EXECUTION}, r4 AS (SELECT seccion_cod, servicio_cod, periodo, {_m("(credito_definitivo - credito_inicial - modificaciones)")} AS diferencia FROM ej
  WHERE list_contains(string_split(cobertura, ','), 'modificaciones') AND credito_inicial IS NOT NULL AND credito_definitivo IS NOT NULL AND modificaciones IS NOT NULL GROUP BY 1, 2, 3), r4f AS (SELECT * FROM r4 WHERE abs(diferencia) > 0.5)"""
_R5 = f"WITH {model.EXECUTION}, r5 AS (SELECT seccion_cod, servicio_cod, periodo, {_m('pagos')} AS pagos, {_m('orn')} AS orn FROM ej WHERE list_contains(string_split(cobertura, ','), 'pagos') GROUP BY 1, 2, 3), r5f AS (SELECT * FROM r5 WHERE pagos > orn + 0.5)"
_R6 = f"WITH {model.EXECUTION}, {model.SERVICES}, r6f AS (SELECT ejercicio, seccion_cod, servicio_cod, count(*) AS n FROM ej WHERE NOT EXISTS (SELECT 1 FROM sv WHERE servicio_denominacion IS NOT NULL AND sv.ejercicio = ej.ejercicio AND sv.seccion_cod = ej.seccion_cod AND sv.servicio_cod = ej.servicio_cod) GROUP BY 1, 2, 3)"
_R8 = metrics._sums("servicio", "true") + """, y AS (SELECT CAST(left(periodo, 4) AS INT) AS ejercicio, * FROM s), mo AS (SELECT ejercicio, periodo, lead(periodo) OVER (PARTITION BY ejercicio ORDER BY periodo) AS nx FROM (SELECT DISTINCT ejercicio, periodo FROM y)),
b AS (SELECT nx AS periodo, seccion_cod, servicio_cod, credito_inicial AS i0, orn AS o0 FROM y JOIN mo USING (ejercicio, periodo) WHERE nx IS NOT NULL),
w AS (SELECT b.periodo, b.seccion_cod, b.servicio_cod, CASE WHEN y.ejercicio IS NULL THEN 'desaparece' WHEN y.orn < o0 - 0.5 THEN 'orn_decrece' WHEN abs(y.credito_inicial - i0) > 0.5 THEN 'inicial_cambia' END AS motivo
  FROM b LEFT JOIN y USING (periodo, seccion_cod, servicio_cod)), r8f AS (SELECT * FROM w WHERE motivo IS NOT NULL)"""


def _r3(level: str) -> str:
    return metrics._sums(level, "true") + f", r3f AS (SELECT {metrics._cols(level)}periodo, orn, credito_definitivo FROM s WHERE orn > credito_definitivo + {TOLERANCE[level]})"


_POOLS = f"""{model.EXECUTION}, {model.SERVICES}, e2 AS (SELECT *, string_split(cobertura, ',') AS cb FROM ej),
g0 AS (SELECT periodo, ejercicio, seccion_cod, servicio_cod, count(*) AS n, {_m("credito_inicial")} AS ini, {_m("credito_definitivo")} AS fin, {_m("orn")} AS orn, {_m("CASE WHEN list_contains(cb, 'modificaciones') THEN credito_definitivo - credito_inicial - modificaciones END")} AS resto,
  {_m("CASE WHEN list_contains(cb, 'pagos') THEN pagos END")} AS pagos, {_m("CASE WHEN list_contains(cb, 'pagos') THEN orn END")} AS orn_p, count(*) FILTER (WHERE credito_inicial < 0) AS ni, count(*) FILTER (WHERE orn < 0) AS no FROM e2 GROUP BY 1, 2, 3, 4),
g AS (SELECT g0.*, sv.ejercicio IS NOT NULL AS con, sv.servicio_denominacion IS NOT NULL AS nom FROM g0 LEFT JOIN sv ON sv.ejercicio = g0.ejercicio AND sv.seccion_cod = g0.seccion_cod AND sv.servicio_cod = g0.servicio_cod),
cv AS (SELECT DISTINCT periodo, unnest(cb) AS x FROM e2), mo AS (SELECT ejercicio, periodo, lag(periodo) OVER (PARTITION BY ejercicio ORDER BY periodo) AS ant FROM (SELECT DISTINCT ejercicio, periodo FROM g)),
ex AS (SELECT periodo, seccion_cod, sum(n) AS n1, sum(CASE WHEN con THEN n ELSE 0 END) AS n2, coalesce({_m("orn")}, 0) AS o1, coalesce({_m("CASE WHEN con THEN orn END")}, 0) AS o2 FROM g GROUP BY 1, 2),
c8 AS (SELECT mo.periodo, p.seccion_cod, p.servicio_cod, c.periodo IS NULL OR coalesce(p.orn, 0) - coalesce(c.orn, 0) > 0.5 OR abs(p.ini - c.ini) > 0.5 AS mal FROM mo JOIN g p ON p.periodo = mo.ant LEFT JOIN g c ON c.periodo = mo.periodo AND c.seccion_cod = p.seccion_cod AND c.servicio_cod = p.servicio_cod)"""
_COUNTS = {
    ("R1", "seccion"): "SELECT periodo, count(*) AS k FROM ex WHERE n1 <> n2 OR abs(o1 - o2) > 5 GROUP BY 1",
    ("R2", "AGE"): "SELECT periodo, 1 AS k FROM ex GROUP BY 1 HAVING sum(n1) <> sum(n2) OR abs(sum(CAST(o1 AS DECIMAL(18,2))) - sum(CAST(o2 AS DECIMAL(18,2)))) > 50",
    **{("R3", a): f"SELECT periodo, count(*) AS k FROM (SELECT periodo{b}, {_m('orn')} AS o, {_m('fin')} AS f FROM g GROUP BY ALL) WHERE o > f + {TOLERANCE[t]} GROUP BY 1" for a, b, t in (("AGE", "", "age"), ("seccion", ", seccion_cod", "seccion"), ("servicio", ", seccion_cod, servicio_cod", "servicio"))},
    ("R4", "derivada"): "SELECT '' AS periodo, 0 AS k WHERE false",
    ("R4", "explicita"): "SELECT periodo, count(*) AS k FROM g WHERE abs(resto) > 0.5 GROUP BY 1",
    ("R5", "servicio"): "SELECT periodo, count(*) AS k FROM g WHERE pagos > orn_p + 0.5 GROUP BY 1",
    ("R6", "ancla"): "SELECT periodo, count(*) AS k FROM g WHERE NOT nom GROUP BY 1",
    ("R7", "inicial"): "SELECT periodo, sum(ni) AS k FROM g GROUP BY 1",
    ("R7", "orn"): "SELECT periodo, sum(no) AS k FROM g GROUP BY 1",
    ("R7", "definitivo"): "SELECT periodo, count(*) AS k FROM g WHERE fin < -0.5 GROUP BY 1",
    ("R8", "servicio"): "SELECT periodo, count(*) AS k FROM c8 WHERE mal GROUP BY 1",
}
_ENGINE = f"WITH {_POOLS}, en AS (" + " UNION ALL ".join(
    f"""SELECT '{r}' AS regla, '{a}' AS ambito, mo.periodo, coalesce(k, 0) AS k, (SELECT string_agg(x, ', ' ORDER BY x) FROM unnest([{", ".join(f"'{x}'" for x in need)}]::VARCHAR[]) u(x) WHERE x NOT IN (SELECT cv.x FROM cv WHERE cv.periodo = mo.periodo)) AS falta, {"ant IS NULL" if r == "R8" else "false"} AS primero FROM mo LEFT JOIN ({_COUNTS[r, a]}) c USING (periodo)"""
    for r, a, need in RULES
) + """), es AS (SELECT regla, ambito, periodo, CASE WHEN falta IS NOT NULL OR primero THEN 'SKIPPED' WHEN k > 0 THEN 'FAIL' ELSE 'PASS' END AS estado, CAST(CASE WHEN falta IS NOT NULL OR primero THEN 0 ELSE k END AS BIGINT) AS descuadres, CASE WHEN falta IS NOT NULL THEN 'sin ' || falta WHEN primero THEN 'primer periodo del ejercicio' END AS motivo FROM en)"""
SQL = {
    "cr1_exposicion": _R1 + " SELECT * FROM r1f",
    "cr2_total": _R1 + f", t AS (SELECT CAST(sum(n_hechos) AS BIGINT) AS n_hechos, CAST(sum(n_vista) AS BIGINT) AS n_vista, {_m('orn_hechos')} AS orn_hechos, {_m('orn_vista')} AS orn_vista FROM r1) SELECT *, CASE WHEN n_hechos <> n_vista OR abs(orn_hechos - orn_vista) > 50 THEN 1 ELSE 0 END AS falla FROM t",
    **{f"cr3_credito_{x}": _r3(x) + " SELECT * FROM r3f" for x in TOLERANCE},
    "cr4a_modificaciones": metrics._sums("seccion", "true") + f", q AS (SELECT *, round(credito_definitivo - credito_inicial, 2) AS m FROM s) SELECT periodo, {_m('m')} AS neta, count(*) FILTER (WHERE m < 0) AS secciones_negativas FROM q GROUP BY 1",
    "cr4b_explicitas": _R4B + " SELECT * FROM r4f",
    "cr5_pagos": _R5 + " SELECT * FROM r5f",
    "cr6_huerfanos": _R6 + " SELECT * FROM r6f",
    "cr7_negativos": f"""WITH {model.EXECUTION}, a AS (SELECT periodo, count(*) FILTER (WHERE credito_inicial < 0) AS inicial, count(*) FILTER (WHERE orn < 0) AS orn FROM ej GROUP BY 1),
b AS (SELECT periodo, count(*) FILTER (WHERE f < 0) AS definitivo FROM (SELECT periodo, seccion_cod, servicio_cod, {_m("credito_definitivo")} AS f FROM ej GROUP BY 1, 2, 3) GROUP BY 1) SELECT * FROM a JOIN b USING (periodo)""",
    "cr8_continuidad": _R8 + " SELECT * FROM r8f",
    "ceng_reglas": _ENGINE + " SELECT * FROM es",
    "ceng_periodo": _ENGINE + f" SELECT * FROM es WHERE periodo = '{metrics.MONTH}'",
}
