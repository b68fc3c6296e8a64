"""Alerts over the metrics (L-01 to L-07): hypotheses for a person to look at, all periods in one plan, each with severity and trust.

A rule gives rows of ALERT: what fires, and one row in state SKIPPED with the reason for each period where the rule cannot be judged
or nothing fires. Only L-01 says nothing where services were judged and none fired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.operators.measures import concentration, money, ratio
from fiscalspark.plans import catalog, metrics, model
from fiscalspark.session import materialise

#: Thresholds of the rules.
RHYTHM = {"history": 3, "least_final": 1e6, "scale": 1.4826, "floor": 8.0, "z": 3.0, "gap": 15.0, "high_z": 6.0, "high_gap": 50.0}
MODIFICATION = {"sections": 5, "scale": 1.4826, "floor": 8.0, "pct": 15.0, "amount": 1e8, "high_pct": 40.0, "high_amount": 1e9}
CONCENTRATION = {"hhi": 2500.0, "high_hhi": 5000.0, "total": 1e5, "suppliers": 2, "anchored": 60.0}
ANTICIPATION = {"awards": 5e6, "ratio": 1.0, "high_ratio": 3.0}
#: Lower thresholds, for data whose amounts and history are smaller.
LOOSE = {
    "ritmo_ejecucion": RHYTHM | {"history": 1, "least_final": 1e5, "z": 0.5, "gap": 3.0},
    "modificacion_atipica": MODIFICATION | {"pct": 2.0, "amount": 1e4},
    "concentracion_adjudicatarios": CONCENTRATION | {"hhi": 1500.0},
    "anticipacion_compromiso": ANTICIPATION | {"awards": 1e5, "ratio": 0.05, "high_ratio": 0.2},
}
#: Severities in their order, and the speed to which each kind of alert belongs.
SEVERITY = {"destacada": 0, "a_revisar": 1, "informativa": 2}
SPEED = {"ritmo_ejecucion": "contable", "modificacion_atipica": "contable", "concentracion_adjudicatarios": "compromisos_juridicos", "anticipacion_compromiso": "compromisos_juridicos"}
ALERT = ["tipo", "estado", "periodo", "nivel", "seccion_cod", "servicio_cod", "dir3_cod", "naturaleza", "severidad", "confianza", "valor", "referencia", "z", "salto", "importe", "n", "pct_cobertura", "motivo", "evidencia"]
_TYPES = {"valor": "double", "referencia": "double", "z": "double", "salto": "double", "importe": "double", "n": "long", "pct_cobertura": "double"}


def shaped(df: DataFrame, kind: str, nature: str, level: str, **cols: Column) -> DataFrame:
    """Rows of ALERT: fixed columns, those given, null for the rest."""
    has = {"tipo": F.lit(kind), "naturaleza": F.lit(nature), "nivel": F.lit(level), "periodo": F.col("periodo")} | cols
    return df.select(*[has.get(c, F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in ALERT])


def evidence(table: str, *cols: str) -> Column:
    """F-21: where the rows behind an alert are, as 'view key=value …'."""
    return F.concat_ws(" ", F.lit(table), *[F.concat(F.lit(f"{c}="), F.col(c)) for c in cols])


def evidence_map(c: Column | str) -> Column:
    """F-21: keys and values of an evidence's text; the word in front is under 'vista'."""
    x = F.col(c) if isinstance(c, str) else c
    return F.str_to_map(F.concat(F.lit("vista="), x), F.lit(" "), F.lit("="))


def periods(spark: SparkSession, d: str, only: list[str] | None) -> DataFrame:
    p = model.execution(spark, d).where("fuente_cod = 'igae_anexo_i'").select("periodo").distinct()
    return p if only is None else p.where(F.col("periodo").isin(*only))


def prorogued(spark: SparkSession, d: str) -> DataFrame:
    """Periods of a year whose budget is that of another year, carried on."""
    return catalog.periods(spark, d).select("periodo", (F.col("prorrogado") == 1).alias("prorroga"))


def skipped(every: DataFrame, fired: DataFrame, kind: str, nature: str, reason: Column) -> DataFrame:
    """One row for each period without alert, with the reason (of the columns of every); no row where the reason is null."""
    quiet = every.join(F.broadcast(fired.select("periodo").distinct()), "periodo", "left_anti").withColumn("motivo", reason).where("motivo IS NOT NULL")
    return shaped(quiet, kind, nature, "AGE", estado=F.lit("SKIPPED"), motivo=F.col("motivo"))


def both(fired: DataFrame, every: DataFrame, kind: str, nature: str, reason: Column) -> DataFrame:
    fired = materialise(fired)
    return fired.unionByName(skipped(every, fired, kind, nature, reason))


def median_of(values: Column) -> Column:
    """Median of an array of numbers that is not empty."""
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def rhythm_alerts(only: list[str] | None = None, limits: dict = RHYTHM):
    """L-01: services whose degree is far from their own in the same month of earlier years: gap over the median in robust units.

    The earlier degrees of a service and month are a list, no longer than there are years.
    """

    def query(spark: SparkSession, d: str) -> DataFrame:
        by = metrics.LEVELS["servicio"]
        s = materialise(metrics.sums(spark, d, "servicio", F.lit(True)).withColumn("pct", ratio("orn", "credito_definitivo", 100.0)))
        every = s.select("periodo").distinct()
        earlier = every.withColumn("previos", F.count("*").over(Window.partitionBy(F.substring("periodo", 6, 2)).orderBy("periodo")) - 1)
        w = Window.partitionBy(*by, F.substring("periodo", 6, 2)).orderBy("periodo").rowsBetween(Window.unboundedPreceding, -1)
        h = s.withColumn("h", F.collect_list("pct").over(w)).withColumn("age", F.sum(F.col("credito_definitivo").cast("decimal(18,2)")).over(Window.partitionBy("periodo")).cast("double"))
        h = h.join(F.broadcast(earlier), "periodo").where(F.col("previos") >= limits["history"])
        judged = h.where((F.size("h") >= limits["history"]) & F.col("pct").isNotNull() & (F.col("credito_definitivo") >= limits["least_final"]))
        if only is not None:
            judged, earlier = judged.where(F.col("periodo").isin(*only)), earlier.where(F.col("periodo").isin(*only))
        judged = judged.withColumn("m", median_of(F.col("h"))).withColumn("mad", median_of(F.transform("h", lambda x: F.abs(x - F.col("m")))))
        scale = F.greatest(F.lit(limits["scale"]) * F.col("mad"), F.lit(limits["floor"]))
        judged = materialise(judged.withColumn("salto", F.col("pct") - F.col("m")).withColumn("z", (F.col("pct") - F.col("m")) / scale).withColumn("n", F.size("h")).drop("h"))
        fired = judged.where((F.abs("z") >= limits["z"]) & (F.abs("salto") >= limits["gap"]))
        unit = leading(spark, d)
        fired = fired.join(F.broadcast(prorogued(spark, d)), "periodo", "left").join(F.broadcast(unit), by, "left")
        high = (F.abs("z") >= limits["high_z"]) | (F.abs("salto") >= limits["high_gap"])
        alerts = shaped(
            fired, "ritmo_ejecucion", "exacta", "servicio", estado=F.lit("ALERTA"), seccion_cod=F.col("seccion_cod"), servicio_cod=F.col("servicio_cod"), dir3_cod=F.col("dir3_cod"), severidad=F.when(high, "destacada").otherwise("a_revisar"),
            confianza=F.when(F.col("prorroga"), "media").otherwise("alta"), valor=F.round("pct", 4), referencia=F.round("m", 4), z=F.round("z", 4), salto=F.round("salto", 4), importe=F.col("credito_definitivo"), n=F.col("n"),
            pct_cobertura=F.round(ratio("credito_definitivo", "age", 100.0), 4), evidencia=evidence("v_ejecucion", "periodo", *by),
        )
        known = earlier.join(F.broadcast(judged.groupBy("periodo").agg(F.count("*").alias("juzgados"))), "periodo", "left")
        reason = F.when(F.col("previos") < limits["history"], "historico insuficiente").when(F.col("juzgados").isNull(), "ningun servicio con historico y credito suficientes")
        return both(alerts, known, "ritmo_ejecucion", "exacta", reason)

    return query


def leading(spark: SparkSession, d: str) -> DataFrame:
    """Unit of each section and service in the newest year of the crosswalk."""
    lead = metrics.leading_unit(spark, d)
    newest = lead.agg(F.max("ejercicio").alias("ejercicio"))
    return lead.join(F.broadcast(newest), "ejercicio").select("seccion_cod", "servicio_cod", "dir3_cod")


def modification_alerts(only: list[str] | None = None, limits: dict = MODIFICATION):
    """L-02: sections whose appropriation was changed much; how far from the median of all sections of the period is shown as context."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        keep = F.lit(True) if only is None else F.col("periodo").isin(*only)
        m = F.col("credito_definitivo") - F.col("credito_inicial")
        s = metrics.sums(spark, d, "seccion", keep).withColumn("mod", F.round(m, 2)).withColumn("pct", ratio(m, "credito_inicial", 100.0))
        # a period has no more values than there are sections
        p = Window.partitionBy("periodo")
        s = s.withColumn("v", F.collect_list("pct").over(p)).withColumn("age", F.sum(F.col("credito_definitivo").cast("decimal(18,2)")).over(p).cast("double"))
        s = materialise(s.withColumn("k", F.size("v")).withColumn("med", F.when(F.size("v") > 0, median_of(F.col("v")))).withColumn("mad", F.when(F.size("v") > 0, median_of(F.transform("v", lambda x: F.abs(x - F.col("med")))))).drop("v"))
        scale = F.greatest(F.lit(limits["scale"]) * F.col("mad"), F.lit(limits["floor"]))
        fired = s.where((F.col("k") >= limits["sections"]) & (F.abs("pct") >= limits["pct"]) & (F.abs("mod") >= limits["amount"])).join(F.broadcast(prorogued(spark, d)), "periodo", "left")
        high = (F.abs("pct") >= limits["high_pct"]) | (F.abs("mod") >= limits["high_amount"])
        alerts = shaped(
            fired, "modificacion_atipica", "exacta", "seccion", estado=F.lit("ALERTA"), seccion_cod=F.col("seccion_cod"), severidad=F.when(high, "destacada").otherwise("a_revisar"), confianza=F.when(F.col("prorroga"), "media").otherwise("alta"),
            valor=F.round("pct", 4), referencia=F.round("med", 4), z=F.round((F.col("pct") - F.col("med")) / scale, 4), importe=F.col("mod"), n=F.col("k"), pct_cobertura=F.round(ratio("credito_definitivo", "age", 100.0), 4), evidencia=evidence("v_ejecucion", "periodo", "seccion_cod"),
        )
        every = s.groupBy("periodo").agg(F.max("k").alias("k"))
        return both(alerts, every, "modificacion_atipica", "exacta", F.when(F.col("k") < limits["sections"], "muy pocas secciones").otherwise("sin secciones fuera del patron"))

    return query


def anchored_share(spark: SparkSession, d: str) -> DataFrame:
    """Share of the awarded amount of each year that is anchored to a service (A-04)."""
    part = F.col("anclaje_tipo") == "servicio"
    s = model.contracts(spark, d).groupBy("ejercicio").agg(F.coalesce(money(F.when(part, F.col("importe_adjudicacion"))), F.lit(0.0)).alias("a"), F.coalesce(money("importe_adjudicacion"), F.lit(0.0)).alias("t"))
    return s.select("ejercicio", F.round(ratio("a", "t", 100.0), 1).alias("anclado"))


def concentration_alerts(only: list[str] | None = None, limits: dict = CONCENTRATION):
    """L-03: bodies whose awards of the period's year are concentrated in few suppliers. One supplier alone is no pattern and only told."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        by = ["seccion_cod", "servicio_cod"]
        every = periods(spark, d, only).withColumn("ejercicio", F.substring("periodo", 1, 4).cast("int"))
        c = materialise(concentration(model.contracts(spark, d).where("anclaje_tipo = 'servicio'"), ["ejercicio", *by], "adjudicatario_id", "importe_adjudicacion"))
        fired = c.where((F.col("hhi") >= limits["hhi"]) & (F.col("importe_total") >= limits["total"])).join(F.broadcast(every), "ejercicio").join(F.broadcast(anchored_share(spark, d)), "ejercicio", "left")
        alone = F.col("n_adjudicatarios") < limits["suppliers"]
        alerts = shaped(
            fired.withColumn("ejercicio", F.col("ejercicio").cast("string")), "concentracion_adjudicatarios", "exacta", "servicio", estado=F.lit("ALERTA"), seccion_cod=F.col("seccion_cod"), servicio_cod=F.col("servicio_cod"),
            severidad=F.when(alone, "informativa").when(F.col("hhi") >= limits["high_hhi"], "destacada").otherwise("a_revisar"), confianza=F.when(alone, "baja").when(F.col("anclado") >= limits["anchored"], "alta").otherwise("baja"),
            valor=F.col("hhi"), referencia=F.lit(limits["hhi"]), importe=F.col("importe_total"), n=F.col("n_adjudicatarios"), pct_cobertura=F.col("anclado"), evidencia=evidence("v_contratos", "ejercicio", *by),
        )
        some = every.join(F.broadcast(c.groupBy("ejercicio").agg(F.count("*").alias("k"))), "ejercicio", "left")
        return both(alerts, some, "concentracion_adjudicatarios", "exacta", F.when(F.col("k").isNull(), "sin contratacion anclada").otherwise("sin organos por encima del umbral"))

    return query


def anticipation_alerts(only: list[str] | None = None, limits: dict = ANTICIPATION):
    """L-04: services whose awards of the year run ahead of their obligations at the period; without obligations the ratio is null and
    they count as infinitely ahead. Always of low trust: the two are no parts of each other."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        by = ["seccion_cod", "servicio_cod"]
        every = materialise(periods(spark, d, only).withColumn("ejercicio", F.substring("periodo", 1, 4).cast("int")))
        keep = F.lit(True) if only is None else F.col("periodo").isin(*only)
        orn = metrics.sums(spark, d, "servicio", keep).select("periodo", *by, "orn")
        awards = model.contracts(spark, d).where("anclaje_tipo = 'servicio'").groupBy("ejercicio", *by).agg(money("importe_adjudicacion").alias("adjudicado")).join(F.broadcast(every), "ejercicio").drop("ejercicio")
        c = orn.join(awards, ["periodo", *by], "full").na.fill(0.0, ["orn", "adjudicado"])
        rel = F.when(F.col("orn") > 0, F.col("adjudicado") / F.col("orn"))
        fired = c.withColumn("rel", rel).where((F.col("adjudicado") >= limits["awards"]) & (F.col("rel").isNull() | (F.col("rel") >= limits["ratio"]))).withColumn("ejercicio", F.substring("periodo", 1, 4)).join(F.broadcast(anchored_share(spark, d).withColumn("ejercicio", F.col("ejercicio").cast("string"))), "ejercicio", "left")
        high = F.col("rel").isNull() | (F.col("rel") >= limits["high_ratio"])
        alerts = shaped(
            fired, "anticipacion_compromiso", "indiciaria", "servicio", estado=F.lit("ALERTA"), seccion_cod=F.col("seccion_cod"), servicio_cod=F.col("servicio_cod"), severidad=F.when(high, "destacada").otherwise("a_revisar"), confianza=F.lit("baja"),
            valor=F.round("rel", 4), referencia=F.col("orn"), importe=F.col("adjudicado"), pct_cobertura=F.col("anclado"), evidencia=evidence("v_contratos", "ejercicio", *by),
        )
        return both(alerts, every, "anticipacion_compromiso", "indiciaria", F.lit("sin servicios con compromiso por encima de la ORN"))

    return query


RULES = {
    "ritmo_ejecucion": (rhythm_alerts, RHYTHM), "modificacion_atipica": (modification_alerts, MODIFICATION), "concentracion_adjudicatarios": (concentration_alerts, CONCENTRATION), "anticipacion_compromiso": (anticipation_alerts, ANTICIPATION),
}


def all_alerts(only: list[str] | None = None, limits: dict[str, dict] | None = None):
    """L-06: every rule over the periods (all of the execution if none is named)."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [rule(only, (limits or {}).get(k, own))(spark, d) for k, (rule, own) in RULES.items()])

    return query


def picked(alerts: DataFrame, state: str | None = "ALERTA", severity: str | None = None, kind: str | None = None, speed: str | None = None, section: str | None = None) -> DataFrame:
    """P-10: alerts of a state, severity, kind, speed and section; what is null is not asked for. Unknown names are errors."""
    for value, known in ((severity, SEVERITY), (kind, SPEED), (speed, set(SPEED.values()))):
        if value is not None and value not in known:
            raise ValueError(f"{value} is none of {', '.join(sorted(known))}")
    for c, v in (("estado", state), ("severidad", severity), ("tipo", kind), ("seccion_cod", section)):
        alerts = alerts if v is None else alerts.where(F.col(c) == v)
    return alerts if speed is None else alerts.where(F.col("tipo").isin(*[k for k, v in SPEED.items() if v == speed]))


def ordered(alerts: DataFrame) -> DataFrame:
    """O-04: by severity, section and service; those without come last."""
    rank = F.coalesce(*[F.when(F.col("severidad") == k, v) for k, v in SEVERITY.items()], F.lit(9))
    return alerts.orderBy(rank, F.coalesce("seccion_cod", F.lit("")), F.coalesce("servicio_cod", F.lit("")), "tipo", "periodo")


def tallies(alerts: DataFrame) -> DataFrame:
    """A-19: alerts by period, state, kind and severity."""
    return alerts.groupBy("periodo", "estado", "tipo", "severidad").agg(F.count("*").alias("n"))


def watched(spark: SparkSession, d: str, only: list[str] | None = None) -> DataFrame:
    """Share of the obligations of each period that stands under a named unit, which is what alerts by unit can see."""
    keep = F.lit(True) if only is None else F.col("periodo").isin(*only)
    s = metrics.sums(spark, d, "servicio", keep).join(F.broadcast(leading(spark, d)), ["seccion_cod", "servicio_cod"], "left")
    t = s.groupBy("periodo").agg(F.coalesce(money(F.when(F.col("dir3_cod").isNotNull(), F.col("orn"))), F.lit(0.0)).alias("a"), money("orn").alias("t"))
    return t.select("periodo", F.round(ratio("a", "t", 100.0), 1).alias("pct_orn_vigilable"))


def report(only: list[str] | None = None, limits: dict[str, dict] | None = None):
    """L-07: for each period the share that is watched, the number of alerts of each severity, and of rules that were skipped."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        a = all_alerts(only, limits)(spark, d)
        fired = F.col("estado") == "ALERTA"
        n = a.groupBy("periodo").agg(F.count_if(fired).alias("alertas"), *[F.count_if(fired & (F.col("severidad") == k)).alias(k) for k in SEVERITY], F.count_if(~fired).alias("omitidas"))
        return periods(spark, d, only).join(n, "periodo", "left").na.fill(0).join(watched(spark, d, only), "periodo", "left")

    return query


def full_report(spark: SparkSession, d: str, period: str) -> dict:
    """L-07 as one document: head, summary, alerts in order, rules skipped. A period has few alerts: at most its sections and services."""
    alerts = all_alerts([period])(spark, d)
    rows = [r.asDict() for r in ordered(alerts).collect()]
    fired = [r for r in rows if r["estado"] == "ALERTA"]
    head = watched(spark, d, [period]).first()
    by = {k: sum(r["severidad"] == k for r in fired) for k in SEVERITY}
    return {"periodo": period, "cobertura_global": {"pct_orn_vigilable": head.pct_orn_vigilable if head else None}, "resumen": {"alertas": len(fired), "por_severidad": by, "skipped": len(rows) - len(fired)}, "alertas": fired, "skipped": [r for r in rows if r["estado"] == "SKIPPED"]}


def loose(kind: str):
    return RULES[kind][0](None, LOOSE[kind])


QUERIES = {
    **{f"{q}": RULES[k][0]() for q, k in (("l01_ritmo", "ritmo_ejecucion"), ("l02_modificacion", "modificacion_atipica"), ("l03_concentracion", "concentracion_adjudicatarios"), ("l04_anticipacion", "anticipacion_compromiso"))},
    **{f"{q}_laxo": loose(k) for q, k in (("l01_ritmo", "ritmo_ejecucion"), ("l02_modificacion", "modificacion_atipica"), ("l03_concentracion", "concentracion_adjudicatarios"), ("l04_anticipacion", "anticipacion_compromiso"))},
    "l06_alertas": all_alerts(), "l07_informe": report(), "l07_informe_laxo": report(None, LOOSE), "a19_recuento": lambda s, d: tallies(all_alerts(None, LOOSE)(s, d)),
}

_m = metrics._money
_NULLS = {c: f"CAST(NULL AS {'BIGINT' if _TYPES.get(c) == 'long' else 'DOUBLE' if c in _TYPES else 'VARCHAR'})" for c in ALERT}


def _row(**cols: str) -> str:
    return ", ".join(f"{cols.get(c, _NULLS[c])} AS {c}" for c in ALERT)


_PERIODS = f"{model.EXECUTION}, pe AS (SELECT DISTINCT periodo, ejercicio FROM ej WHERE fuente_cod = 'igae_anexo_i')"
_PRO = f"{model.SERVICES}, pl AS (SELECT ejercicio, min(presupuesto) AS presupuesto FROM sv GROUP BY 1), pr AS (SELECT periodo, upper(trim(presupuesto)) LIKE '%-P' AS prorroga FROM pe LEFT JOIN pl USING (ejercicio))"
_LEAD = f"{model.BRIDGE}, {model.UNITS}, {metrics._UNIT}, le AS (SELECT seccion_cod, servicio_cod, dir3_cod FROM dgu WHERE ejercicio = (SELECT max(ejercicio) FROM dgu))"
_SUMS = lambda by: f"SELECT {by}, periodo, {', '.join(f'{_m(c)} AS {c}' for c in ('credito_inicial', 'credito_definitivo', 'orn'))} FROM ej GROUP BY ALL"
_SHARE = f"{model.CONTRACTS}, sh AS (SELECT ejercicio, round(100.0 * coalesce({_m('CASE WHEN anclaje_tipo = ' + chr(39) + 'servicio' + chr(39) + ' THEN importe_adjudicacion END')}, 0) / nullif(coalesce({_m('importe_adjudicacion')}, 0), 0), 1) AS anclado FROM ct GROUP BY 1)"
_HEAD = f"{_PERIODS}, {_PRO}, {_LEAD}, {_SHARE}"


def _l01(x: dict) -> str:
    alert = _row(tipo="'ritmo_ejecucion'", estado="'ALERTA'", periodo="periodo", nivel="'servicio'", seccion_cod="seccion_cod", servicio_cod="servicio_cod", dir3_cod="dir3_cod", naturaleza="'exacta'", severidad=f"CASE WHEN abs(z) >= {x['high_z']} OR abs(salto) >= {x['high_gap']} THEN 'destacada' ELSE 'a_revisar' END",
        confianza="CASE WHEN prorroga THEN 'media' ELSE 'alta' END", valor="round(pct, 4)", referencia="round(m, 4)", z="round(z, 4)", salto="round(salto, 4)", importe="credito_definitivo", n="k", pct_cobertura="round(100.0 * credito_definitivo / nullif(age, 0), 4)", evidencia="concat('v_ejecucion periodo=', periodo, ' seccion_cod=', seccion_cod, ' servicio_cod=', servicio_cod)")
    skip = _row(tipo="'ritmo_ejecucion'", estado="'SKIPPED'", periodo="periodo", nivel="'AGE'", naturaleza="'exacta'", motivo="motivo")
    return f"""a0 AS ({_SUMS("seccion_cod, servicio_cod")}), a1 AS (SELECT *, 100.0 * orn / nullif(credito_definitivo, 0) AS pct FROM a0),
a2 AS (SELECT periodo, count(*) OVER (PARTITION BY substr(periodo, 6, 2) ORDER BY periodo) - 1 AS previos FROM (SELECT DISTINCT periodo FROM a1)), ag AS (SELECT periodo, {_m("credito_definitivo")} AS age FROM a1 GROUP BY 1),
a3 AS (SELECT c.periodo, c.seccion_cod, c.servicio_cod, any_value(c.pct) AS pct, any_value(c.credito_definitivo) AS credito_definitivo, count(h.pct) AS k, median(h.pct) AS m, mad(h.pct) AS mad
  FROM a1 c JOIN a1 h ON h.seccion_cod IS NOT DISTINCT FROM c.seccion_cod AND h.servicio_cod IS NOT DISTINCT FROM c.servicio_cod AND substr(h.periodo, 6, 2) = substr(c.periodo, 6, 2) AND h.periodo < c.periodo GROUP BY 1, 2, 3),
a4 AS (SELECT a3.*, age, pct - m AS salto, (pct - m) / greatest({x["scale"]} * mad, {x["floor"]}) AS z FROM a3 JOIN a2 USING (periodo) JOIN ag USING (periodo) WHERE previos >= {x["history"]} AND k >= {x["history"]} AND pct IS NOT NULL AND credito_definitivo >= {x["least_final"]}),
a5 AS (SELECT a4.*, prorroga, dir3_cod FROM a4 LEFT JOIN pr USING (periodo) LEFT JOIN le USING (seccion_cod, servicio_cod) WHERE abs(z) >= {x["z"]} AND abs(salto) >= {x["gap"]}),
a6 AS (SELECT periodo, CASE WHEN previos < {x["history"]} THEN 'historico insuficiente' WHEN periodo NOT IN (SELECT periodo FROM a4) THEN 'ningun servicio con historico y credito suficientes' END AS motivo FROM a2 WHERE periodo NOT IN (SELECT periodo FROM a5)),
r1 AS (SELECT {alert} FROM a5 UNION ALL SELECT {skip} FROM a6 WHERE motivo IS NOT NULL)"""


def _l02(x: dict) -> str:
    alert = _row(tipo="'modificacion_atipica'", estado="'ALERTA'", periodo="periodo", nivel="'seccion'", seccion_cod="seccion_cod", naturaleza="'exacta'", severidad=f"CASE WHEN abs(pct) >= {x['high_pct']} OR abs(mod) >= {x['high_amount']} THEN 'destacada' ELSE 'a_revisar' END", confianza="CASE WHEN prorroga THEN 'media' ELSE 'alta' END",
        valor="round(pct, 4)", referencia="round(med, 4)", z=f"round((pct - med) / greatest({x['scale']} * mad, {x['floor']}), 4)", importe="mod", n="k", pct_cobertura="round(100.0 * credito_definitivo / nullif(age, 0), 4)", evidencia="concat('v_ejecucion periodo=', periodo, ' seccion_cod=', seccion_cod)")
    skip = _row(tipo="'modificacion_atipica'", estado="'SKIPPED'", periodo="periodo", nivel="'AGE'", naturaleza="'exacta'", motivo=f"CASE WHEN k < {x['sections']} THEN 'muy pocas secciones' ELSE 'sin secciones fuera del patron' END")
    return f"""b0 AS ({_SUMS("seccion_cod")}), b1 AS (SELECT *, round(credito_definitivo - credito_inicial, 2) AS mod, 100.0 * (credito_definitivo - credito_inicial) / nullif(credito_inicial, 0) AS pct FROM b0),
b2 AS (SELECT periodo, count(pct) AS k, median(pct) AS med, mad(pct) AS mad, {_m("credito_definitivo")} AS age FROM b1 GROUP BY 1),
b3 AS (SELECT b1.*, k, med, mad, age, prorroga FROM b1 JOIN b2 USING (periodo) LEFT JOIN pr USING (periodo) WHERE k >= {x["sections"]} AND abs(pct) >= {x["pct"]} AND abs(mod) >= {x["amount"]}),
r2 AS (SELECT {alert} FROM b3 UNION ALL SELECT {skip} FROM b2 WHERE periodo NOT IN (SELECT periodo FROM b3))"""


def _l03(x: dict) -> str:
    alert = _row(tipo="'concentracion_adjudicatarios'", estado="'ALERTA'", periodo="periodo", nivel="'servicio'", seccion_cod="seccion_cod", servicio_cod="servicio_cod", naturaleza="'exacta'", severidad=f"CASE WHEN k < {x['suppliers']} THEN 'informativa' WHEN hhi >= {x['high_hhi']} THEN 'destacada' ELSE 'a_revisar' END",
        confianza=f"CASE WHEN k < {x['suppliers']} THEN 'baja' WHEN anclado >= {x['anchored']} THEN 'alta' ELSE 'baja' END", valor="hhi", referencia=f"{x['hhi']}", importe="total", n="k", pct_cobertura="anclado", evidencia="concat('v_contratos ejercicio=', ejercicio, ' seccion_cod=', seccion_cod, ' servicio_cod=', servicio_cod)")
    skip = _row(tipo="'concentracion_adjudicatarios'", estado="'SKIPPED'", periodo="periodo", nivel="'AGE'", naturaleza="'exacta'", motivo="CASE WHEN ejercicio NOT IN (SELECT ejercicio FROM c2) THEN 'sin contratacion anclada' ELSE 'sin organos por encima del umbral' END")
    return f"""c0 AS (SELECT ejercicio, seccion_cod, servicio_cod, adjudicatario_id, {_m("importe_adjudicacion")} AS imp FROM ct WHERE anclaje_tipo = 'servicio' AND adjudicatario_id IS NOT NULL AND importe_adjudicacion > 0 GROUP BY ALL),
c1 AS (SELECT *, imp / sum(imp) OVER (PARTITION BY ejercicio, seccion_cod, servicio_cod) AS s FROM c0), c2 AS (SELECT ejercicio, seccion_cod, servicio_cod, count(*) AS k, {_m("imp")} AS total, round(10000 * sum(s * s), 0) AS hhi FROM c1 GROUP BY 1, 2, 3),
c3 AS (SELECT c2.*, periodo, anclado FROM c2 JOIN pe USING (ejercicio) LEFT JOIN sh USING (ejercicio) WHERE hhi >= {x["hhi"]} AND total >= {x["total"]}),
r3 AS (SELECT {alert} FROM c3 UNION ALL SELECT {skip} FROM pe WHERE periodo NOT IN (SELECT periodo FROM c3))"""


def _l04(x: dict) -> str:
    alert = _row(tipo="'anticipacion_compromiso'", estado="'ALERTA'", periodo="periodo", nivel="'servicio'", seccion_cod="seccion_cod", servicio_cod="servicio_cod", naturaleza="'indiciaria'", severidad=f"CASE WHEN rel IS NULL OR rel >= {x['high_ratio']} THEN 'destacada' ELSE 'a_revisar' END", confianza="'baja'",
        valor="round(rel, 4)", referencia="orn", importe="adjudicado", pct_cobertura="anclado", evidencia="concat('v_contratos ejercicio=', left(periodo, 4), ' seccion_cod=', seccion_cod, ' servicio_cod=', servicio_cod)")
    skip = _row(tipo="'anticipacion_compromiso'", estado="'SKIPPED'", periodo="periodo", nivel="'AGE'", naturaleza="'indiciaria'", motivo="'sin servicios con compromiso por encima de la ORN'")
    return f"""d0 AS (SELECT periodo, seccion_cod, servicio_cod, {_m("orn")} AS orn FROM ej GROUP BY 1, 2, 3), d1 AS (SELECT periodo, seccion_cod, servicio_cod, adjudicado FROM (SELECT ejercicio, seccion_cod, servicio_cod, {_m("importe_adjudicacion")} AS adjudicado FROM ct WHERE anclaje_tipo = 'servicio' GROUP BY 1, 2, 3) JOIN pe USING (ejercicio)),
d2 AS (SELECT periodo, seccion_cod, servicio_cod, coalesce(orn, 0) AS orn, coalesce(adjudicado, 0) AS adjudicado FROM d0 FULL JOIN d1 USING (periodo, seccion_cod, servicio_cod)), d3 AS (SELECT *, CASE WHEN orn > 0 THEN adjudicado / orn END AS rel FROM d2),
d4 AS (SELECT d3.*, anclado FROM d3 LEFT JOIN sh ON sh.ejercicio = CAST(left(periodo, 4) AS INT) WHERE adjudicado >= {x["awards"]} AND (rel IS NULL OR rel >= {x["ratio"]})),
r4 AS (SELECT {alert} FROM d4 UNION ALL SELECT {skip} FROM pe WHERE periodo NOT IN (SELECT periodo FROM d4))"""


def _all(x: dict) -> str:
    k = list(RULES)
    return f"WITH {_HEAD}, {_l01(x[k[0]])}, {_l02(x[k[1]])}, {_l03(x[k[2]])}, {_l04(x[k[3]])}, al AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)"


_OWN = {k: v[1] for k, v in RULES.items()}
_REPORT = f""", n AS (SELECT periodo, count(*) FILTER (WHERE estado = 'ALERTA') AS alertas, {", ".join(f"count(*) FILTER (WHERE estado = 'ALERTA' AND severidad = '{k}') AS {k}" for k in SEVERITY)}, count(*) FILTER (WHERE estado <> 'ALERTA') AS omitidas FROM al GROUP BY 1),
w AS (SELECT periodo, round(100.0 * coalesce({_m("CASE WHEN dir3_cod IS NOT NULL THEN orn END")}, 0) / nullif({_m("orn")}, 0), 1) AS pct_orn_vigilable FROM (SELECT periodo, seccion_cod, servicio_cod, {_m("orn")} AS orn FROM ej GROUP BY 1, 2, 3) LEFT JOIN le USING (seccion_cod, servicio_cod) GROUP BY 1)
SELECT pe.periodo, coalesce(alertas, 0) AS alertas, {", ".join(f"coalesce({k}, 0) AS {k}" for k in SEVERITY)}, coalesce(omitidas, 0) AS omitidas, pct_orn_vigilable FROM pe LEFT JOIN n USING (periodo) LEFT JOIN w USING (periodo)"""
SQL = {
    **{q: f"WITH {_HEAD}, {f(_OWN[k])} SELECT * FROM {r}" for q, k, f, r in (("l01_ritmo", "ritmo_ejecucion", _l01, "r1"), ("l02_modificacion", "modificacion_atipica", _l02, "r2"), ("l03_concentracion", "concentracion_adjudicatarios", _l03, "r3"), ("l04_anticipacion", "anticipacion_compromiso", _l04, "r4"))},
    **{f"{q}_laxo": f"WITH {_HEAD}, {f(LOOSE[k])} SELECT * FROM {r}" for q, k, f, r in (("l01_ritmo", "ritmo_ejecucion", _l01, "r1"), ("l02_modificacion", "modificacion_atipica", _l02, "r2"), ("l03_concentracion", "concentracion_adjudicatarios", _l03, "r3"), ("l04_anticipacion", "anticipacion_compromiso", _l04, "r4"))},
    "l06_alertas": _all(_OWN) + " SELECT * FROM al",
    "l07_informe": _all(_OWN) + _REPORT,
    "l07_informe_laxo": _all(LOOSE) + _REPORT,
    "a19_recuento": _all(LOOSE) + " SELECT periodo, estado, tipo, severidad, count(*) AS n FROM al GROUP BY 1, 2, 3, 4",
}
