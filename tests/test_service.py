from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fiscalspark import cli
from fiscalspark.operators.ascend import ascend, nodes
from fiscalspark.operators.measures import concentration, median_mad, ratio
from fiscalspark.service import BadRequest, NotFound, Service

DATA = "/root/testdata/sf0.001"


def test_pages_and_errors(spark):
    s = Service(spark, DATA)
    first = s.degree("2025-10", "seccion", page=1, size=3)
    second = s.degree("2025-10", "seccion", page=2, size=3)
    assert len(first["data"]) == 3 and first["meta"]["has_next"] and first["meta"]["warnings"]
    assert not {r["seccion_cod"] for r in first["data"]} & {r["seccion_cod"] for r in second["data"]}
    assert s.health()["meta"]["total"] == 1
    assert s.catalogue("programas", size=1)["data"]
    assert {r["tipo"] for r in s.report()["data"]} == {"ritmo", "modificacion", "concentracion", "anticipacion"}
    for call in (lambda: s.degree("2025-13"), lambda: s.degree("2025-10", "nada"), lambda: s.concentration(2025, top=51), lambda: s.years(page=0), lambda: s.years(size=1001)):
        with pytest.raises(BadRequest):
            call()
    for call in (lambda: s.degree("1999-01"), lambda: s.catalogue("x"), lambda: s.volume("x", 2025), lambda: s.alerts("x")):
        with pytest.raises(NotFound):
            call()


def test_levels_add_up(spark):
    s = Service(spark, DATA)
    total = s.degree("2025-10", "age")["data"][0]["orn"]
    for level in ("seccion", "servicio", "dg", "capitulo"):
        assert sum(r["orn"] or 0 for r in s.degree("2025-10", level, size=1000)["data"]) == pytest.approx(total, abs=0.01)


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0
    assert "m01_grado_age" in capsys.readouterr().out
    assert cli.main(["run", "m14_frescura", DATA, str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1


def test_measures(spark):
    df = spark.createDataFrame([("g", "a", 95.0), ("g", "b", 5.0), ("g", None, 9.0), ("g", "c", -1.0), ("h", "a", 1.0)], "g string, s string, i double")
    got = {r.g: r for r in concentration(df, ["g"], "s", "i", top=1).collect()}
    assert (got["g"].n_adjudicatarios, got["g"].hhi, got["g"].pct_top, got["h"].hhi) == (2, 9050.0, 95.0, 10000.0)
    r = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double").select(ratio("a", "b").alias("r")).collect()
    assert [x.r for x in r] == [None, None, 0.25]
    v = spark.createDataFrame([("k", x) for x in (1.0, 2.0, 4.0, None, 9.0)], "k string, v double")
    assert [tuple(x) for x in median_mad(v, ["k"], "v").collect()] == [("k", 4, 3.0, 1.5)]


D = dt.date


def test_ascent_labels(spark):
    versions = spark.createDataFrame(
        [("MIN", None, None, D(2010, 1, 1), None), ("DG", "MIN", None, D(2010, 1, 1), None), ("J", "DG", "MN", D(2010, 1, 1), None), ("OA", "MIN", "OA", D(2010, 1, 1), None), ("OAX", "OA", None, D(2010, 1, 1), None), ("EX", "MIN", None, D(2010, 1, 1), D(2015, 1, 1)), ("L1", "L2", None, D(2010, 1, 1), None), ("L2", "L1", None, D(2010, 1, 1), None)],
        "code string, parent string, kind string, ini date, fin date",
    )
    targets = spark.createDataFrame([("DG", 2026, "20", "03"), ("DG", 2026, "20", "05")], "code string, year int, a string, b string").select("code", "year", F.struct("a", "b").alias("target"))
    asked = spark.createDataFrame([(c, D(2026, 5, 1), 2026) for c in ("DG", "J", "OAX", "EX", "MIN", "L1", "XX")] + [("J", D(2019, 1, 1), 2019), ("J", None, 2026)], "code string, day date, year int")
    got = {(r.code, r.year, r.day is None): r for r in ascend(asked, nodes(versions, targets), "MN").collect()}
    assert {k[0]: r.end for k, r in got.items() if k[1:] == (2026, False)} == {"DG": "destino", "J": "destino", "OAX": "propia", "EX": "fin", "MIN": "fin", "L1": "fin", "XX": "fin"}
    assert (got["J", 2026, False].at, tuple(got["J", 2026, False].target), got["J", 2026, True].end) == ("DG", ("20", "03"), "destino")
    assert (got["J", 2019, False].covered, got["J", 2019, False].known, got["XX", 2026, False].known) == (False, True, False)


def test_status_and_windows(spark, tmp_path):
    s = Service(spark, DATA)
    assert s.call("root")[0] == 200 and s.call("nada")[0] == 404 and s.call("volume", flow="x")[0] == 404 and s.call("volume", flow="contratos", period="2025-13")[0] == 422 and s.call("degree")[0] == 422
    assert Service(spark, str(tmp_path)).call("years")[0] == 503
    n = {k: s.volume("contratos", level="age", **w)["data"][0]["n"] for k, w in {"all": {}, "year": {"year": 2025}, "month": {"period": "2025-10"}, "both": {"period": "2025-10", "year": 2024}}.items()}
    assert n["all"] > n["year"] > n["month"] == n["both"]
    out = s.volume("subvenciones", 2025, "seccion")
    assert out["meta"]["cobertura_anclaje"]["servicio"]["n"] == sum(r["n"] for r in out["data"])
    assert any("prórroga" in w for w in s.degree("2025-10")["meta"]["warnings"]) and s.decisions_and_commitment(2025)["data"] and s.decisions("cdm", "ministerio")["data"]
    for call in (lambda: s.decisions("x"),):
        with pytest.raises(NotFound):
            call()


def test_alerts_in_their_order(spark):
    s = Service(spark, DATA)
    got = s.alert_list("2025-10")["data"]
    rank = [{"destacada": 0, "a_revisar": 1, "informativa": 2}[r["severidad"]] for r in got]
    assert rank == sorted(rank) and got
    some = s.alert_list("2025-10", severity=got[0]["severidad"], speed="compromisos_juridicos", section=got[0]["seccion_cod"])["data"]
    assert some and all(r["seccion_cod"] == got[0]["seccion_cod"] and r["tipo"] in ("concentracion_adjudicatarios", "anticipacion_compromiso") for r in some)
    for bad in ({"severity": "x"}, {"kind": "x"}, {"speed": "x"}):
        with pytest.raises(BadRequest):
            s.alert_list("2025-10", **bad)
    doc = s.period_report("2025-10")["data"]
    assert doc["resumen"]["alertas"] == len(doc["alertas"]) == len(got) and doc["resumen"]["skipped"] == len(doc["skipped"]) and doc["cobertura_global"]["pct_orn_vigilable"] is not None


def test_evidence_is_a_map(spark):
    from fiscalspark.plans import alerts

    got = spark.createDataFrame([("v_ejecucion periodo=2025-10 seccion_cod=01",)], "e string").select(alerts.evidence_map("e").alias("m")).first().m
    assert got == {"vista": "v_ejecucion", "periodo": "2025-10", "seccion_cod": "01"}


def test_commands(spark, tmp_path, capsys):
    import json

    code = cli.main(["check", DATA, "--period", "2025-10", "--json"])
    rows = json.loads(capsys.readouterr().out)
    assert len(rows) == 13 and code == int(any(r["estado"] == "FAIL" for r in rows))
    cli.main(["check", DATA, "--period", "2025-10"])
    assert "Resumen:" in capsys.readouterr().out
    assert cli.main(["check", DATA, "--period", "1999-01"]) == 1 and "1999-01" in capsys.readouterr().err
    assert cli.main(["report", DATA, "2025-10"]) == 0 and json.loads(capsys.readouterr().out)["periodo"] == "2025-10"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f").write_text("x")
    m = ["manifest", str(tmp_path / "c"), str(tmp_path / "m.json")]
    assert cli.main(m) == 0 and cli.main([*m, "--verify"]) == 0
    (tmp_path / "c" / "f").write_text("y")
    assert cli.main([*m, "--verify"]) == 1 and cli.main(["diagnose", "bdns", str(tmp_path / "c" / "f")]) == 1
