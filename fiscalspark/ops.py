"""Running the engine: names of published files, run summaries, incidents, order of the work, freshness (F-18, F-23 to F-25, G-09, T-06, T-07, Z-02 to Z-05)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fiscalspark.store import Ledger, digest_of

#: Months as the names of published files have them.
MONTHS = ("ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE")
#: Days after which a source of this cadence is behind.
CADENCE = {"mensual": 45, "diaria": 3, "semanal": 10, "continua": 10}
#: Groups of assets: what each is made from, and how it is cut.
GRAPH = {
    "semillas": ((), None), "dimensiones": (("semillas",), None), "ejecucion": (("dimensiones",), "mensual"), "contratos": (("dimensiones", "crosswalk"), "diaria"), "subvenciones": (("dimensiones", "crosswalk"), "diaria"),
    "decisiones": (("dimensiones",), "diaria"), "crosswalk": (("semillas", "dimensiones"), None), "validacion": (("ejecucion",), "mensual"), "frescura": (("ejecucion", "contratos", "subvenciones", "decisiones"), None),
}


def month_name(period: str) -> str:
    """F-23: name of the month of a period, and back by month_of."""
    return MONTHS[int(period[5:7]) - 1]


def month_of(name: str) -> int:
    return MONTHS.index(name.strip().upper()) + 1


def month_column(period: Column | str) -> Column:
    """F-23 as a column: name of the month of a period; null for another shape."""
    c = F.col(period) if isinstance(period, str) else period
    return F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(MONTHS, 1) for x in (f"{i:02d}", n)]), F.substring(c, 6, 2))


def execution_file(period: str) -> str:
    """F-23: published name of a month's workbook."""
    return f"MENSUAL {month_name(period)} {period[:4]} ANEXO I.xlsx"


def execution_url(period: str, base: str) -> str:
    return f"{base.rstrip('/')}/{quote(execution_file(period))}"


def reference_url(template: str, day: Column | str) -> Column:
    """F-18: address of a cabinet reference from a template with {anio} and {fecha} (YYYYMMDD); the template depends on the layout's age."""
    d = F.col(day) if isinstance(day, str) else day
    t = F.replace(F.lit(template), F.lit("{anio}"), F.date_format(d, "yyyy"))
    return F.replace(t, F.lit("{fecha}"), F.date_format(d, "yyyyMMdd"))


def light(last: Column | str, cadence: Column | str, today: Column | None = None) -> Column:
    """F-25: 'verde' within the days of the cadence, 'ambar' within twice as many, 'rojo' beyond, 'sin_datos' without a day."""
    c = F.col(cadence) if isinstance(cadence, str) else cadence
    days = F.coalesce(*[F.when(c == k, v) for k, v in CADENCE.items()], F.lit(CADENCE["mensual"]))
    age = F.datediff(F.current_date() if today is None else today, F.col(last) if isinstance(last, str) else last)
    return F.when(age.isNull(), "sin_datos").when(age <= days, "verde").when(age <= days * 2, "ambar").otherwise("rojo")


#: Kinds of failure by the classes of the errors that bring them about.
FAILURES = {
    "formato_cambiado": {"BadMonth", "SourceFormatError", "BadZipFile", "ParseError"},
    "validacion_contable": {"RejectedLoad", "OrphanError", "ContractError"},
    "respuesta_vacia": {"EmptySource"},
    "fuente_no_disponible": {"TimeoutError", "ConnectionError"},
    "error_carga": {"ConcurrentLoad", "PySparkException", "Py4JError"},
}


def failure_kind(error: BaseException) -> str:
    """F-24: kind of a failure, by its class or one that it is made from."""
    own = {c.__name__ for c in type(error).__mro__}
    return next((k for k, classes in FAILURES.items() if own & classes), "error_publicacion")


@dataclass(frozen=True)
class Incident:
    """Z-02: a failure as it is told to people."""

    kind: str
    source: str
    partition: str | None
    at: str
    diagnosis: str
    raw: str | None = None

    def fingerprint(self) -> str:
        """The same for the same failure, so that it is told once."""
        return f"fiscalspark:{self.kind}:{self.source}:{self.partition or '-'}"

    def text(self) -> str:
        lines = [f"### [{self.kind.upper()}] {self.source}", "", f"- Partition: {self.partition or '-'}", f"- At: {self.at}"]
        return "\n".join([*lines, *([f"- Raw: `{self.raw}`"] if self.raw else []), "", self.diagnosis])


def untold(incidents: list[Incident], told: set[str]) -> list[Incident]:
    """Incidents that were not told before, each once, in order."""
    out, seen = [], set(told)
    for i in incidents:
        if i.fingerprint() not in seen:
            seen.add(i.fingerprint())
            out.append(i)
    return out


class SourceFormatError(ValueError):
    """A source's file is not of the known shape."""


class EmptySource(ValueError):
    """A source's answer holds nothing."""


def watched(source: str, partition: str | None, ledger: Ledger, work, raw: str | None = None):
    """Z-05: run the work of a source, note its attempt and its end in the ledger, and give what it gives; a failure is noted as an incident
    (under 'incidente') and raised on."""
    ledger.note(source, "intento", partition=partition)
    try:
        rows = work()
    except Exception as e:
        i = Incident(failure_kind(e), source, partition, dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), str(e)[:2000], raw)
        ledger.note(source, "fallo", kind=i.kind, partition=partition, fingerprint=i.fingerprint(), diagnosis=i.diagnosis)
        raise
    ledger.note(source, "exito", partition=partition, rows=rows)
    return rows


def run_summary(ledger: Ledger, sources: list[str], partition: str, ok: bool, commit: str | None = None) -> str:
    """Z-03: summary of a run from the ledger."""
    known = [e for s, e in ledger.read().items() if s in sources]
    rows = sum(int(e.get("exito", {}).get("rows") or 0) for e in known)
    last = max((e["exito"]["at"] for e in known if "exito" in e), default="-")
    pairs = (("Sources", ", ".join(sources)), ("Partition", partition), ("Rows", rows), ("Last success", last), ("Commit", commit or "-"), ("Checks", "passed" if ok else "failed"))
    return "\n".join(["## Run", "", *[f"- {k}: {v}" for k, v in pairs], ""])


def default_partition(group: str, today: dt.date | None = None) -> str | None:
    """T-06: the partition that a group is materialised for if none is named: this month or today."""
    cut, d = GRAPH[group][1], today or dt.date.today()
    return None if cut is None else f"{d:%Y-%m}" if cut == "mensual" else d.isoformat()


def order(groups: list[str]) -> list[str]:
    """G-09: the groups and all they are made from, each after what it is made from. A loop in the graph is an error."""
    out: list[str] = []

    def visit(g: str, above: tuple[str, ...]) -> None:
        if g in above:
            raise ValueError(f"loop at {g}")
        for x in GRAPH[g][0]:
            visit(x, (*above, g))
        if g not in out:
            out.append(g)

    for g in groups:
        visit(g, ())
    return out


def stale(spark: SparkSession, inputs: dict[str, str], ledger: Ledger) -> list[str]:
    """G-09: assets whose input (a path) has another digest than when they were made last; they and what is made from them are to be made again."""
    old = ledger.read()
    changed = [a for a, path in inputs.items() if digest_of(spark, path)[0] != old.get(f"asset:{a}", {}).get("hecho", {}).get("digest")]
    return [g for g in order(list(GRAPH)) if g in changed or any(g != c and c in order([g]) for c in changed)]


def made(spark: SparkSession, asset: str, path: str, ledger: Ledger) -> None:
    ledger.note(f"asset:{asset}", "hecho", digest=digest_of(spark, path)[0])
