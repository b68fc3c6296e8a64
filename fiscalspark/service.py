"""The query surface (H-01 to H-20) without a server: one call per endpoint gives {data, meta}, paged, with checked parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fiscalspark.files import Files
from fiscalspark.plans import alerts, catalog, decisions, metrics, model

PERIOD = re.compile(r"^\d{4}-(0[1-9]|1[0-2])$")
#: Nature of the figures, and what must be said with them.
ACCUMULATED = "Los importes de ejecución son acumulados del año: los periodos se comparan, no se suman."
RESIDUAL = "Lo que ninguna unidad atribuye queda en la fila residual."


PROROGUED = "Periodo en prórroga: el crédito inicial es el prorrogado, no el de un presupuesto propio del año."
ADDITIVE = "Los importes se suman por ventana de tiempo; solo el anclaje 'servicio' atribuye a sección y servicio."
FALLIBLE = "Importes extraídos de textos: se dan por confianza, con los que no tienen importe aparte."
INDICATIVE = "Aproximación indiciaria, no identidad contable: las dos magnitudes se dan por separado."
#: Names of the endpoints.
ENDPOINTS = ("health", "freshness", "years", "sections", "services", "catalogue", "degree", "rhythm", "year_on_year", "modifications", "volume", "concentration", "decisions", "commitment", "decisions_and_commitment", "alerts", "alert_list", "report", "period_report")


class Unavailable(RuntimeError):
    """There is no data to ask (503)."""


class BadRequest(ValueError):
    """A parameter is not allowed (422)."""


class NotFound(LookupError):
    """What was asked for is not loaded or does not exist (404)."""


def paged(df: DataFrame, order: list, page: int = 1, size: int = 200) -> dict:
    """O-07: one page in a total order, with the number of rows and whether more follow."""
    if page < 1 or not 1 <= size <= 1000:
        raise BadRequest("page from 1, size from 1 to 1000")
    total = df.count()
    rows = (df.orderBy(*order) if order else df).offset((page - 1) * size).limit(size).collect()
    return {"data": [r.asDict(recursive=True) for r in rows], "meta": {"page": page, "size": size, "total": total, "has_next": page * size < total}}


class Service:
    """Endpoints over a data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def ready(self) -> None:
        """G-07: Unavailable unless the facts can be read."""
        if not Files(self.spark).exists(f"{self.dir}/fact_ejecucion.parquet"):
            raise Unavailable(f"no facts under {self.dir}")

    def call(self, endpoint: str, **params) -> tuple[int, dict]:
        """An endpoint by name: status and body; errors become 404, 422 and 503 with their message."""
        if endpoint != "root" and endpoint not in ENDPOINTS:
            return 404, {"error": {"code": "not_found", "message": endpoint}}
        try:
            if endpoint != "root":
                self.ready()
            return 200, getattr(self, endpoint)(**params)
        except NotFound as e:
            return 404, {"error": {"code": "not_found", "message": str(e)}}
        except (BadRequest, TypeError) as e:
            return 422, {"error": {"code": "bad_request", "message": str(e)}}
        except Unavailable as e:
            return 503, {"error": {"code": "unavailable", "message": str(e)}}

    def _level(self, level: str, allowed: tuple[str, ...] = tuple(metrics.LEVELS)) -> list[str]:
        if level not in allowed:
            raise BadRequest(f"level must be one of {', '.join(allowed)}")
        return metrics.LEVELS[level]

    def _period(self, period: str) -> str:
        if not PERIOD.match(period):
            raise BadRequest("period must be YYYY-MM")
        if model.execution(self.spark, self.dir).where(F.col("periodo") == period).limit(1).isEmpty():
            raise NotFound(f"{period} is not loaded")
        return period

    def _give(self, query: Callable, order: list[str], first: str | None = None, page: int = 1, size: int = 200, warnings: list[str] = ()) -> dict:
        df = query(self.spark, self.dir)
        keys = [F.desc_nulls_last(first)] if first else []
        out = paged(df, keys + [F.asc_nulls_last(c) for c in order], page, size)
        out["meta"]["warnings"] = list(warnings)
        return out

    def health(self) -> dict:
        return self._give(catalog.health, [])

    def freshness(self, **p) -> dict:
        return self._give(catalog.freshness, ["fuente_cod"], **p)

    def root(self) -> dict:
        """G-07: what there is to ask."""
        return {"data": [{"name": n} for n in ENDPOINTS], "meta": {"total": len(ENDPOINTS), "warnings": []}}

    def years(self, **p) -> dict:
        return self._give(catalog.years, [], "ejercicio", **p)

    def sections(self, year: int, **p) -> dict:
        return self._give(lambda s, d: catalog.sections(s, d).where(F.col("ejercicio") == year), ["seccion_cod"], **p)

    def services(self, year: int, section: str, **p) -> dict:
        return self._give(lambda s, d: catalog.services(s, d).where((F.col("ejercicio") == year) & (F.col("seccion_cod") == section)), ["servicio_cod"], **p)

    def catalogue(self, name: str, **p) -> dict:
        known = {"programas": (catalog.programmes, "programa_cod"), "economicas": (catalog.economics, "economica_cod"), "fuentes": (catalog.freshness, "fuente_cod")}
        if name not in known:
            raise NotFound(name)
        return self._give(known[name][0], [known[name][1]], **p)

    def _warn(self, period: str, level: str) -> list[str]:
        """M-13: what must be said with execution figures."""
        carried = not catalog.periods(self.spark, self.dir).where((F.col("periodo") == period) & (F.col("prorrogado") == 1)).isEmpty()
        return [ACCUMULATED, *([PROROGUED] if carried else []), *([RESIDUAL] if level == "dg" else [])]

    def _window(self, period: str | None, year: int | None) -> tuple[str | None, int | None]:
        """P-01: a period goes before a year; neither means all."""
        if period is not None and not PERIOD.match(period):
            raise BadRequest("period must be YYYY-MM")
        return period, year

    def degree(self, period: str, level: str = "age", **p) -> dict:
        by = self._level(level)
        return self._give(metrics.degree(level, self._period(period)), by, "orn", warnings=self._warn(period, level), **p)

    def rhythm(self, year: int, level: str = "age", **p) -> dict:
        return self._give(metrics.rhythm(level, year), [*self._level(level), "periodo"], warnings=[ACCUMULATED], **p)

    def year_on_year(self, period: str, level: str = "age", **p) -> dict:
        by = self._level(level)
        return self._give(metrics.year_on_year(level, self._period(period)), by, warnings=self._warn(period, level), **p)

    def modifications(self, period: str, level: str = "seccion", **p) -> dict:
        by = self._level(level)
        return self._give(metrics.modifications(level, self._period(period)), by, "modificacion_abs", warnings=self._warn(period, level), **p)

    def _with_cover(self, out: dict, flow: str, year: int | None, period: str | None) -> dict:
        """A-04: what share of the window's amount is anchored, beside the figures."""
        rows = metrics.anchoring(flow, year, period)(self.spark, self.dir).collect()
        out["meta"]["cobertura_anclaje"] = {r.anclaje_tipo or "nulo": {"n": r.n, "importe": r.importe, "pct_importe": r.pct_importe} for r in rows}
        return out

    def volume(self, flow: str, year: int | None = None, level: str = "age", period: str | None = None, **p) -> dict:
        if flow not in metrics.FLOWS:
            raise NotFound(flow)
        period, year = self._window(period, year)
        out = self._give(metrics.volume(flow, level, year, period), self._level(level, ("age", "seccion", "servicio", "dg")), "importe", warnings=[ADDITIVE], **p)
        return self._with_cover(out, flow, year, period)

    def concentration(self, year: int | None = None, level: str = "servicio", top: int = 5, period: str | None = None, **p) -> dict:
        if not 1 <= top <= 50:
            raise BadRequest("top from 1 to 50")
        period, year = self._window(period, year)
        out = self._give(metrics.suppliers(level, year, top, period), self._level(level, ("seccion", "servicio", "dg")), "hhi", **p)
        return self._with_cover(out, "contratos", year, period)

    def decisions(self, source: str = "boe", level: str = "seccion", year: int | None = None, period: str | None = None, **p) -> dict:
        if source not in decisions.SOURCES:
            raise NotFound(source)
        if level not in ("seccion", "ministerio"):
            raise BadRequest("level must be seccion or ministerio")
        period, year = self._window(period, year)
        return self._give(decisions.volume(source, level, year, period), ["grupo", "tipo"], "n", warnings=[FALLIBLE], **p)

    def commitment(self, period: str, level: str = "seccion", **p) -> dict:
        return self._give(metrics.commitment(level, self._period(period)), self._level(level, ("seccion", "servicio")), "adjudicado", warnings=[INDICATIVE], **p)

    def decisions_and_commitment(self, year: int, **p) -> dict:
        return self._give(decisions.against_commitment(year), ["seccion_cod"], "adjudicado", warnings=[INDICATIVE, FALLIBLE], **p)

    def alert_list(self, period: str, severity: str | None = None, kind: str | None = None, speed: str | None = None, section: str | None = None, page: int = 1, size: int = 200) -> dict:
        """H-20: alerts of a period in their order, as far as asked for."""
        rows = alerts.all_alerts([self._period(period)])(self.spark, self.dir)
        try:
            rows = alerts.picked(rows, "ALERTA", severity, kind, speed, section)
        except ValueError as e:
            raise BadRequest(str(e)) from e
        rank = F.coalesce(*[F.when(F.col("severidad") == k, v) for k, v in alerts.SEVERITY.items()], F.lit(9))
        return paged(rows, [rank, F.asc_nulls_first("seccion_cod"), F.asc_nulls_first("servicio_cod"), F.col("tipo")], page, size)

    def period_report(self, period: str) -> dict:
        """H-19: the report of a period as one document."""
        return {"data": alerts.full_report(self.spark, self.dir, self._period(period)), "meta": {"warnings": []}}

    def alerts(self, kind: str, **p) -> dict:
        rules = {"ritmo": "ritmo_ejecucion", "modificacion": "modificacion_atipica", "concentracion": "concentracion_adjudicatarios", "anticipacion": "anticipacion_compromiso"}
        if kind not in rules:
            raise NotFound(kind)
        return self._give(alerts.RULES[rules[kind]][0](), ["periodo", "seccion_cod", "servicio_cod"], **p)

    def report(self, **p) -> dict:
        """Alerts of all periods by kind."""
        names = {"ritmo_ejecucion": "ritmo", "modificacion_atipica": "modificacion", "concentracion_adjudicatarios": "concentracion", "anticipacion_compromiso": "anticipacion"}
        kind = F.coalesce(*[F.when(F.col("tipo") == k, v) for k, v in names.items()])
        return self._give(lambda s, d: alerts.all_alerts()(s, d).groupBy(kind.alias("tipo")).agg(F.count_if(F.col("estado") == "ALERTA").alias("n")), ["tipo"], **p)
