"""Command line for spark-submit (X-02 to X-06): queries, warehouse build and update, checks, alerts, groups of assets, manifests, diagnosis."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from fiscalspark import build, ops
from fiscalspark.plans import alerts, checks, registry
from fiscalspark.sources import sentinel
from fiscalspark.store import Ledger, RejectedLoad, Warehouse, digest_of, write_manifest

#: Groups of assets that a capture of these sources fills.
GROUP_SOURCES = {"contratos": ("placsp",), "subvenciones": ("bdns",), "decisiones": ("boe", "consejo_ministros")}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fiscalspark")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="write the result of a query as Parquet")
    run.add_argument("query", choices=sorted(registry.QUERIES))
    run.add_argument("data")
    run.add_argument("out")
    check = sub.add_parser("check", help="run the accounting checks; exit 1 if one fails or a period is not loaded")
    check.add_argument("data")
    check.add_argument("--period", action="append")
    check.add_argument("--json", action="store_true")
    report = sub.add_parser("report", help="alerts of a period")
    report.add_argument("data")
    report.add_argument("period")
    for name, what in (("build", "make the warehouse anew from raw files"), ("update", "load what is new in the raw files")):
        b = sub.add_parser(name, help=what)
        b.add_argument("raw")
        b.add_argument("warehouse")
        b.add_argument("--seeds", required=True, help="folder of CSV files by table name")
        b.add_argument("--captured", help="day of capture of the months, else their first day")
        b.add_argument("--ledger")
    m = sub.add_parser("materialize", help="load one group of assets for a partition that is there already; nothing is downloaded")
    m.add_argument("group", choices=sorted({"ejecucion", *GROUP_SOURCES}))
    m.add_argument("raw")
    m.add_argument("warehouse")
    m.add_argument("--partition")
    m.add_argument("--ledger", required=True)
    man = sub.add_parser("manifest", help="write or verify the manifest of a capture")
    man.add_argument("capture")
    man.add_argument("target")
    man.add_argument("--verify", action="store_true")
    d = sub.add_parser("diagnose", help="what a file is, or what about it is not as expected; exit 1 if so")
    d.add_argument("source")
    d.add_argument("file")
    s = sub.add_parser("summary", help="summary of a run from the ledger")
    s.add_argument("ledger")
    s.add_argument("partition")
    s.add_argument("--source", action="append", default=[])
    s.add_argument("--failed", action="store_true")
    sub.add_parser("list", help="names of the queries")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if a.command == "diagnose":
        found = sentinel.diagnose(a.source, a.file)
        print(json.dumps(asdict(found), ensure_ascii=False))
        return int(not found.valid)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return COMMANDS[a.command](spark, a)
    except (build.OrphanError, build.ContractError, RejectedLoad, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1


def _run(spark: SparkSession, a) -> int:
    registry.QUERIES[a.query](spark, a.data).write.mode("errorifexists").parquet(a.out)
    return 0


def _check(spark: SparkSession, a) -> int:
    order = ["periodo", "regla", "ambito"]
    rows = [r.asDict() for r in checks.run_checks(spark, a.data, a.period).orderBy(*order).collect()]
    print(json.dumps(rows, ensure_ascii=False) if a.json else checks.as_text(rows))
    return int(any(r["estado"] == "FAIL" for r in rows))


def _report(spark: SparkSession, a) -> int:
    print(json.dumps(alerts.full_report(spark, a.data, a.period), ensure_ascii=False, default=str))
    return 0


def _build(spark: SparkSession, a) -> int:
    work = build.build if a.command == "build" else build.update
    done = lambda: work(spark, a.raw, a.warehouse, build.read_seeds(spark, a.seeds), a.captured)
    if a.ledger:
        result: dict = {}
        ops.watched(a.command, None, Ledger(a.ledger, spark), lambda: result.update(done()) or sum(result.values()), a.raw)
    else:
        result = done()
    print(json.dumps(result))
    return 0


def _materialize(spark: SparkSession, a) -> int:
    part = a.partition or ops.default_partition(a.group)
    w, led = Warehouse(spark, a.warehouse), Ledger(a.ledger, spark)
    if a.group == "ejecucion":
        ops.watched("igae_mensual", part, led, lambda: build.load_month(w, build.igae.read_month(spark, a.raw, part, f"{part}-01")), a.raw)
    else:
        for source in GROUP_SOURCES[a.group]:
            if part in build.discover_captures(spark, a.raw, source):
                ops.watched(source, part, led, lambda source=source: build.load_capture(w, a.raw, source, part), a.raw)
    return 0


def _manifest(spark: SparkSession, a) -> int:
    if not a.verify:
        print(write_manifest(spark, a.capture, a.target))
        return 0
    from fiscalspark.files import Files

    same = json.loads(Files(spark).read(a.target))["digest"] == digest_of(spark, a.capture)[0]
    print("same" if same else "other")
    return int(not same)


def _summary(spark: SparkSession, a) -> int:
    print(ops.run_summary(Ledger(a.ledger, spark), a.source, a.partition, not a.failed))
    return 0


COMMANDS = {"run": _run, "check": _check, "report": _report, "build": _build, "update": _build, "materialize": _materialize, "manifest": _manifest, "summary": _summary}

if __name__ == "__main__":
    sys.exit(main())
