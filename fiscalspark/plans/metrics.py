"""Metrics over execution, contracts and grants (M-01 to M-14), each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.operators.measures import concentration, money, ratio
from fiscalspark.plans import model

#: Level of aggregation: grouping columns.
LEVELS: dict[str, list[str]] = {
    "age": [],
    "seccion": ["seccion_cod"],
    "servicio": ["seccion_cod", "servicio_cod"],
    "programa": ["programa_cod"],
    "economica": ["economica_cod"],
    "capitulo": ["capitulo"],
    "dg": ["dir3_cod"],
}
#: What a unit's level counts for when a service leads to several units.
PRIORITY = {"direccion_general": 1, "secretaria_estado": 2, "subsecretaria": 3, "organismo": 4, "ministerio": 5}
RESIDUE = "SIN_DG"
#: Year and month of the registered queries.
YEAR, MONTH = 2025, "2025-10"


def leading_unit(spark: SparkSession, d: str) -> DataFrame:
    """M-11: of the units that a service leads to, the one of highest level (then smallest code); one per service and year."""
    level = F.coalesce(*[F.when(F.col("nivel_organico") == k, v) for k, v in PRIORITY.items()], F.lit(9))
    latest = model.units(spark, d).groupBy("dir3_cod").agg(F.max_by("nivel_organico", "fecha_inicio").alias("nivel_organico"))
    return model.bridge(spark, d).join(latest, "dir3_cod", "left").groupBy("ejercicio", "seccion_cod", "servicio_cod").agg(F.min(F.struct(level.alias("p"), "dir3_cod")).alias("b")).select("ejercicio", "seccion_cod", "servicio_cod", F.col("b.dir3_cod").alias("dir3_cod"))


def at_level(rows: DataFrame, level: str, spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """rows with the columns of the level, and those columns. Chapters are the first digit of the economic code; services
    without unit come under RESIDUE."""
    if level == "capitulo":
        rows = rows.withColumn("capitulo", F.substring("economica_cod", 1, 1))
    if level == "dg":
        rows = rows.join(leading_unit(spark, d), ["ejercicio", "seccion_cod", "servicio_cod"], "left").withColumn("dir3_cod", F.coalesce("dir3_cod", F.lit(RESIDUE)))
    return rows, LEVELS[level]


def sums(spark: SparkSession, d: str, level: str, keep: Column) -> DataFrame:
    """A-01: initial and final appropriation and net obligations by level and period."""
    rows, by = at_level(model.execution(spark, d).where(keep), level, spark, d)
    return rows.groupBy(*by, "periodo").agg(*[money(c).alias(c) for c in ("credito_inicial", "credito_definitivo", "orn")])


def degree(level: str, period: str = MONTH):
    """M-01: execution degree of a period by level."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return sums(spark, d, level, F.col("periodo") == period).withColumn("modificacion", F.round(F.col("credito_definitivo") - F.col("credito_inicial"), 2)).withColumn("pct_ejecucion", F.round(ratio("orn", "credito_definitivo", 100.0), 4))

    return query


def rhythm(level: str, year: int = YEAR):
    """M-02: execution degree in each month of a year."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        # the period is a key of the deliveries, so its front prunes the scan; the year is only known of the latest delivery
        return sums(spark, d, level, F.col("periodo").startswith(f"{year}-")).withColumn("pct_ejecucion", F.round(ratio("orn", "credito_definitivo", 100.0), 4))

    return query


def year_on_year(level: str, period: str = MONTH):
    """M-03: a period against the same month a year before; both sides from one scan, null keys meeting null keys."""
    before = f"{int(period[:4]) - 1}{period[4:]}"

    def query(spark: SparkSession, d: str) -> DataFrame:
        s = sums(spark, d, level, F.col("periodo").isin(period, before))
        now = lambda c, p: F.max(F.when(F.col("periodo") == p, F.col(c)))
        wide = s.groupBy(*LEVELS[level]).agg(now("orn", period).alias("orn"), now("credito_definitivo", period).alias("credito_definitivo"), now("orn", before).alias("orn_prev"), now("credito_definitivo", before).alias("credito_definitivo_prev"))
        pct, prev = ratio("orn", "credito_definitivo", 100.0), ratio("orn_prev", "credito_definitivo_prev", 100.0)
        return wide.withColumn("pct_ejecucion", F.round(pct, 4)).withColumn("pct_ejecucion_prev", F.round(prev, 4)).withColumn("delta_pct_ejecucion", F.round(pct - prev, 4))

    return query


def modifications(level: str, period: str = MONTH):
    """M-04: credit modifications of a period."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        m = F.col("credito_definitivo") - F.col("credito_inicial")
        return sums(spark, d, level, F.col("periodo") == period).select(*LEVELS[level], "credito_inicial", "credito_definitivo", F.round(m, 2).alias("modificacion_abs"), F.round(ratio(m, "credito_inicial", 100.0), 4).alias("modificacion_pct"))

    return query


FLOWS = {"contratos": (model.contracts, "importe_adjudicacion"), "subvenciones": (model.grants, "importe")}


def window_of(period: str | None, year: int | None) -> Column:
    """P-01: rows of a period, else of a year, else all; a period goes before a year. A period of another shape is an error."""
    if period is not None:
        if not re.match(r"^\d{4}-(0[1-9]|1[0-2])$", period):
            raise ValueError(f"period must be YYYY-MM: {period}")
        return F.col("periodo") == period
    return F.lit(True) if year is None else F.col("ejercicio") == year


def volume(flow: str, level: str, year: int | None = YEAR, period: str | None = None):
    """M-05, M-06: number and amount of contracts or grants of a window of time. Sections and services count what is anchored to a
    service, units what has a unit, the grand total everything."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        frame, amount = FLOWS[flow]
        rows = frame(spark, d).where(window_of(period, year))
        if level in ("seccion", "servicio"):
            rows = rows.where("anclaje_tipo = 'servicio'")
        elif level == "dg":
            rows = rows.where("anclaje_dir3_cod IS NOT NULL").withColumn("dir3_cod", F.col("anclaje_dir3_cod"))
        return rows.groupBy(*LEVELS[level]).agg(F.count("*").alias("n"), money(amount).alias("importe"))

    return query


def anchoring(flow: str, year: int | None = YEAR, period: str | None = None):
    """A-04: rows and amount by kind of anchor, with their percentages: what share of a volume its levels can show."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        frame, amount = FLOWS[flow]
        s = frame(spark, d).where(window_of(period, year)).groupBy("anclaje_tipo").agg(F.count("*").alias("n"), F.coalesce(money(amount), F.lit(0.0)).alias("importe"))
        w = Window.partitionBy(F.lit(1))
        return s.select("anclaje_tipo", "n", "importe", F.round(ratio(F.col("n").cast("double"), F.sum("n").over(w).cast("double"), 100.0), 4).alias("pct_n"), F.round(ratio("importe", F.sum(F.col("importe").cast("decimal(18,2)")).over(w).cast("double"), 100.0), 4).alias("pct_importe"))

    return query


def suppliers(level: str, year: int | None = YEAR, top: int = 5, period: str | None = None):
    """M-07: concentration of suppliers by body in a window of time."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = model.contracts(spark, d).where(window_of(period, year) & (F.col("anclaje_tipo") == "servicio"))
        if level == "dg":
            rows = rows.where("anclaje_dir3_cod IS NOT NULL").withColumn("dir3_cod", F.col("anclaje_dir3_cod"))
        return concentration(rows, LEVELS[level], "adjudicatario_id", "importe_adjudicacion", top)

    return query


def commitment(level: str, period: str = MONTH):
    """M-09: awards of the year against obligations up to the period; both sides are summed first, missing sides are 0."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        by = LEVELS[level]
        orn = sums(spark, d, level, F.col("periodo") == period).select(*by, "orn")
        awards = volume("contratos", level, int(period[:4]))(spark, d).select(*by, F.col("importe").alias("adjudicado"))
        both = orn.join(awards, by, "full").na.fill(0.0, ["orn", "adjudicado"])
        return both.select(*by, "orn", "adjudicado", F.round(ratio("adjudicado", "orn"), 4).alias("ratio"))

    return query


def unit_coverage(period: str = MONTH):
    """M-12: obligations that a unit answers for, and the rest."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        named = F.col("dir3_cod") != RESIDUE
        g = sums(spark, d, "dg", F.col("periodo") == period).agg(F.coalesce(money(F.when(named, F.col("orn"))), F.lit(0.0)).alias("orn_atribuido"), money("orn").alias("orn_total"))
        return g.withColumn("pct_atribuido", F.round(ratio("orn_atribuido", "orn_total", 100.0), 4))

    return query


def freshness(spark: SparkSession, d: str) -> DataFrame:
    """M-14: last capture, first and last period of the execution."""
    return model.execution(spark, d).agg(F.max("fecha_captura").alias("ultima_captura"), F.min("periodo").alias("desde"), F.max("periodo").alias("hasta"))


QUERIES = {
    **{f"m01_grado_{x}": degree(x) for x in LEVELS},
    **{f"m02_ritmo_{x}": rhythm(x) for x in ("age", "seccion", "servicio")},
    **{f"m03_interanual_{x}": year_on_year(x) for x in ("age", "seccion", "dg")},
    **{f"m04_modificaciones_{x}": modifications(x) for x in ("seccion", "programa")},
    **{f"m05_contratos_{x}": volume("contratos", x) for x in ("age", "seccion", "servicio", "dg")},
    **{f"m06_subvenciones_{x}": volume("subvenciones", x) for x in ("age", "seccion", "servicio", "dg")},
    **{f"m07_concentracion_{x}": suppliers(x) for x in ("seccion", "servicio", "dg")},
    **{f"m09_compromiso_{x}": commitment(x) for x in ("seccion", "servicio")},
    "m11_unidad_de_servicio": leading_unit,
    "m12_cobertura_dg": unit_coverage(),
    "m14_frescura": freshness,
    **{f"a04_anclaje_{x}": anchoring(x) for x in FLOWS},
    "m05_contratos_seccion_periodo": volume("contratos", "seccion", None, MONTH),
    "m05_contratos_seccion_todo": volume("contratos", "seccion", None),
    "m06_subvenciones_servicio_periodo": volume("subvenciones", "servicio", None, MONTH),
    "m06_subvenciones_dg_todo": volume("subvenciones", "dg", None),
    "m07_concentracion_servicio_periodo": suppliers("servicio", None, 5, MONTH),
    "m07_concentracion_seccion_todo": suppliers("seccion", None),
    "a04_anclaje_contratos_periodo": anchoring("contratos", None, MONTH),
    "a04_anclaje_subvenciones_todo": anchoring("subvenciones", None),
}

_UNIT = f"""lu AS (SELECT br.ejercicio, br.seccion_cod, br.servicio_cod,
  min((CASE n.nivel_organico {" ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())} ELSE 9 END) || '|' || br.dir3_cod) AS b
  FROM br LEFT JOIN (SELECT dir3_cod, arg_max(nivel_organico, fecha_inicio) AS nivel_organico FROM un GROUP BY dir3_cod) n USING (dir3_cod) GROUP BY ALL),
dgu AS (SELECT ejercicio, seccion_cod, servicio_cod, split_part(b, '|', 2) AS dir3_cod FROM lu)"""
_MONEY = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"


def _money(c: str) -> str:
    return _MONEY.format(c)


def _cols(level: str) -> str:
    return "".join(f"{c}, " for c in LEVELS[level])


def _sums(level: str, keep: str) -> str:
    source = {"capitulo": "(SELECT *, left(economica_cod, 1) AS capitulo FROM ej)", "dg": f"(SELECT ej.*, coalesce(dgu.dir3_cod, '{RESIDUE}') AS dir3_cod FROM ej LEFT JOIN dgu USING (ejercicio, seccion_cod, servicio_cod))"}.get(level, "ej")
    extra = f"{model.BRIDGE}, {model.UNITS}, {_UNIT}, " if level == "dg" else ""
    return f"""WITH {extra}{model.EXECUTION}, s AS (SELECT {_cols(level)}periodo, {", ".join(f"{_money(c)} AS {c}" for c in ("credito_inicial", "credito_definitivo", "orn"))}
  FROM {source} WHERE {keep} GROUP BY ALL)"""


_PCT = "round(100.0 * {0} / nullif({1}, 0), 4)"


def _volume(flow: str, level: str, window: int | str) -> str:
    window = f"ejercicio = {window}" if isinstance(window, int) else window
    cte, name, amount = {"contratos": (model.CONTRACTS, "ct", "importe_adjudicacion"), "subvenciones": (model.GRANTS, "sb", "importe")}[flow]
    keep = {"age": "", "dg": "AND anclaje_dir3_cod IS NOT NULL"}.get(level, "AND anclaje_tipo = 'servicio'")
    cols = "anclaje_dir3_cod AS dir3_cod, " if level == "dg" else _cols(level)
    group = "GROUP BY ALL" if LEVELS[level] else ""
    return f"{cte}, v AS (SELECT {cols}count(*) AS n, {_money(amount)} AS importe FROM {name} WHERE {window} {keep} {group})"


def _suppliers(level: str, window: str = f"ejercicio = {YEAR}") -> str:
    col = "anclaje_dir3_cod AS dir3_cod, " if level == "dg" else _cols(level)
    by = _cols(level)
    part = by.rstrip(", ")
    return f"""WITH {model.CONTRACTS}, b AS (SELECT {col}adjudicatario_id, {_money("importe_adjudicacion")} AS imp FROM ct
  WHERE {window} AND anclaje_tipo = 'servicio' {"AND anclaje_dir3_cod IS NOT NULL" if level == "dg" else ""} AND adjudicatario_id IS NOT NULL AND importe_adjudicacion > 0 GROUP BY ALL),
r AS (SELECT *, imp / sum(imp) OVER (PARTITION BY {part}) AS sh, row_number() OVER (PARTITION BY {part} ORDER BY imp DESC, adjudicatario_id) AS rn FROM b)
SELECT {by}count(*) AS n_adjudicatarios, {_money("imp")} AS importe_total, round(10000 * sum(sh * sh), 0) AS hhi, round(100 * sum(CASE WHEN rn <= 5 THEN sh ELSE 0 END), 1) AS pct_top FROM r GROUP BY ALL"""


def _year_on_year(level: str) -> str:
    before = f"{int(MONTH[:4]) - 1}{MONTH[4:]}"
    side = lambda c, p: f"max({c}) FILTER (WHERE periodo = '{p}')"
    group = "GROUP BY ALL" if LEVELS[level] else ""
    return _sums(level, f"periodo IN ('{MONTH}', '{before}')") + f""", w AS (SELECT {_cols(level)}{side("orn", MONTH)} AS orn, {side("credito_definitivo", MONTH)} AS credito_definitivo, {side("orn", before)} AS orn_prev,
  {side("credito_definitivo", before)} AS credito_definitivo_prev FROM s {group})
SELECT *, {_PCT.format("orn", "credito_definitivo")} AS pct_ejecucion, {_PCT.format("orn_prev", "credito_definitivo_prev")} AS pct_ejecucion_prev,
  round(100.0 * orn / nullif(credito_definitivo, 0) - 100.0 * orn_prev / nullif(credito_definitivo_prev, 0), 4) AS delta_pct_ejecucion FROM w"""


def _commitment(level: str) -> str:
    by = LEVELS[level]
    return _sums(level, f"periodo = '{MONTH}'") + f""", {_volume("contratos", level, int(MONTH[:4]))}, j AS (SELECT {_cols(level)}coalesce(s.orn, 0) AS orn, coalesce(v.importe, 0) AS adjudicado FROM s FULL JOIN v USING ({", ".join(by)}))
SELECT *, round(adjudicado / nullif(orn, 0), 4) AS ratio FROM j"""


def _anchoring(flow: str, window: str = f"ejercicio = {YEAR}") -> str:
    cte, name, amount = {"contratos": (model.CONTRACTS, "ct", "importe_adjudicacion"), "subvenciones": (model.GRANTS, "sb", "importe")}[flow]
    return f"""WITH {cte}, s AS (SELECT anclaje_tipo, count(*) AS n, coalesce({_money(amount)}, 0) AS importe FROM {name} WHERE {window} GROUP BY 1)
SELECT *, round(100.0 * n / nullif(CAST(sum(n) OVER () AS DOUBLE), 0), 4) AS pct_n, round(100.0 * importe / nullif(CAST(sum(CAST(importe AS DECIMAL(18,2))) OVER () AS DOUBLE), 0), 4) AS pct_importe FROM s"""


SQL = {
    **{f"m01_grado_{x}": _sums(x, f"periodo = '{MONTH}'") + f" SELECT *, round(credito_definitivo - credito_inicial, 2) AS modificacion, {_PCT.format('orn', 'credito_definitivo')} AS pct_ejecucion FROM s" for x in LEVELS},
    **{f"m02_ritmo_{x}": _sums(x, f"ejercicio = {YEAR}") + f" SELECT *, {_PCT.format('orn', 'credito_definitivo')} AS pct_ejecucion FROM s" for x in ("age", "seccion", "servicio")},
    **{f"m03_interanual_{x}": _year_on_year(x) for x in ("age", "seccion", "dg")},
    **{f"m04_modificaciones_{x}": _sums(x, f"periodo = '{MONTH}'") + f" SELECT {_cols(x)}credito_inicial, credito_definitivo, round(credito_definitivo - credito_inicial, 2) AS modificacion_abs, round(100.0 * (credito_definitivo - credito_inicial) / nullif(credito_inicial, 0), 4) AS modificacion_pct FROM s" for x in ("seccion", "programa")},
    **{f"m05_contratos_{x}": f"WITH {_volume('contratos', x, YEAR)} SELECT * FROM v" for x in ("age", "seccion", "servicio", "dg")},
    **{f"m06_subvenciones_{x}": f"WITH {_volume('subvenciones', x, YEAR)} SELECT * FROM v" for x in ("age", "seccion", "servicio", "dg")},
    **{f"m07_concentracion_{x}": _suppliers(x) for x in ("seccion", "servicio", "dg")},
    **{f"m09_compromiso_{x}": _commitment(x) for x in ("seccion", "servicio")},
    "m11_unidad_de_servicio": f"WITH {model.BRIDGE}, {model.UNITS}, {_UNIT} SELECT * FROM dgu",
    "m12_cobertura_dg": _sums("dg", f"periodo = '{MONTH}'") + f", g AS (SELECT coalesce({_money(f'''CASE WHEN dir3_cod <> '{RESIDUE}' THEN orn END''')}, 0) AS orn_atribuido, {_money('orn')} AS orn_total FROM s) SELECT *, {_PCT.format('orn_atribuido', 'orn_total')} AS pct_atribuido FROM g",
    "m14_frescura": f"WITH {model.EXECUTION} SELECT max(fecha_captura) AS ultima_captura, min(periodo) AS desde, max(periodo) AS hasta FROM ej",
    **{f"a04_anclaje_{x}": _anchoring(x) for x in FLOWS},
    "m05_contratos_seccion_periodo": f"WITH {_volume('contratos', 'seccion', f"periodo = '{MONTH}'")} SELECT * FROM v",
    "m05_contratos_seccion_todo": f"WITH {_volume('contratos', 'seccion', 'true')} SELECT * FROM v",
    "m06_subvenciones_servicio_periodo": f"WITH {_volume('subvenciones', 'servicio', f"periodo = '{MONTH}'")} SELECT * FROM v",
    "m06_subvenciones_dg_todo": f"WITH {_volume('subvenciones', 'dg', 'true')} SELECT * FROM v",
    "m07_concentracion_servicio_periodo": _suppliers("servicio", f"periodo = '{MONTH}'"),
    "m07_concentracion_seccion_todo": _suppliers("seccion", "true"),
    "a04_anclaje_contratos_periodo": _anchoring("contratos", f"periodo = '{MONTH}'"),
    "a04_anclaje_subvenciones_todo": _anchoring("subvenciones", "true"),
}
