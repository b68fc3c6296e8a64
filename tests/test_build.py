from __future__ import annotations

import datetime as dt
import json

import pytest
from test_sources import ENTRY, RESULT, feed, workbook

from fiscalspark import build, cli, ops
from fiscalspark.sources import igae, sentinel
from fiscalspark.store import ConcurrentLoad, Ledger, RejectedLoad, Warehouse
from fiscalspark.tables import TABLES

D = dt.date
MONTH = [
    ["Dirección", "0101  911O   22706 -Estudios", "100", "120", "60"],
    ["Dirección", "0101 911O 2270601-Otros", "10", "10", "5"],
    [None, "TOTAL SERVICIO", "110", "130", "65"],
]


def raw_folder(tmp_path):
    raw = tmp_path / "raw"
    for period, rows in (("2026-01", [[r[0], r[1], r[2], r[3], str(int(r[4]) // 5)] for r in MONTH]), ("2026-02", MONTH)):
        (raw / "igae_mensual" / period).mkdir(parents=True)
        workbook(raw / "igae_mensual" / period / f"MENSUAL {period} ANEXO I.xlsx", {"S5": [["CRÉDITO INICIAL"]], "S01": rows})
    (raw / "igae_mensual" / "notas").mkdir()
    (raw / "placsp" / "2026-02-10").mkdir(parents=True)
    award = ENTRY.format(id="10", up="2026-02-01", st="RES", results=RESULT.format(day="2026-01-15", lot="", imp=10))
    (raw / "placsp" / "2026-02-10" / "a.atom").write_text(feed(award))
    (raw / "bdns" / "2026-02-10").mkdir(parents=True)
    g = {"id": 1, "codConcesion": "SB1", "fechaConcesion": "2026-01-05", "fechaAlta": "2026-01-06", "beneficiario": "A1234567B ACME", "importe": 10.0, "nivel1": "ESTADO", "nivel2": "Ministerio de Cosas", "nivel3": "D.G. de Mesas"}
    (raw / "bdns" / "2026-02-10" / "p.json").write_text(json.dumps({"content": [g, g | {"id": 2, "nivel1": "LOCAL"}, g | {"id": 3, "nivel3": "Otra"}]}))
    day = raw / "boe" / "2026-02-10" / "20260209"
    day.mkdir(parents=True)
    (day / "sumario.xml").write_text('<sumario><metadatos><fecha>20260209</fecha></metadatos><diario><seccion codigo="1"><departamento nombre="MINISTERIO DE COSAS"><item><identificador>BOE-A-1</identificador><titulo>Orden por la que se convocan ayudas</titulo></item></departamento></seccion></diario></sumario>')
    (raw / "consejo_ministros" / "2026-02-10").mkdir(parents=True)
    (raw / "consejo_ministros" / "2026-02-10" / "2026-02-09.html").write_text("<h2>SUMARIO</h2><h3>Cosas</h3><ul><li>ACUERDO por el que se autoriza un gasto por importe de 2.000 euros</li><li>Bloque<ul><li>CONVENIO con X</li></ul></li></ul>")
    return raw


def seeds(spark):
    services = spark.createDataFrame([(2026, "01", "01", "Ministerio de Cosas", "Dirección", "2026", "seed_pge")], "ejercicio int, seccion_cod string, servicio_cod string, seccion_denominacion string, servicio_denominacion string, presupuesto string, origen string")
    units = spark.createDataFrame([("E00000001", "Ministerio de Cosas", None, "E00000001", 1, "V", D(2020, 1, 1)), ("E00000002", "Dirección General de Mesas", "E00000001", "E00000001", 2, "V", D(2020, 1, 1))], "dir3_cod string, denominacion string, dir3_padre_cod string, ministerio_dir3_cod string, nivel_jerarquico int, estado string, fecha_inicio date")
    cross = spark.createDataFrame([(2026, "01", "01", "E00000001", "exacto")], "ejercicio int, seccion_cod string, servicio_cod string, dir3_cod string, match_tipo string")
    return {"dim_seccion_servicio": services, "dim_organica": units, "crosswalk": cross}


def test_build_and_update_from_raw_files(spark, tmp_path):
    raw, root = raw_folder(tmp_path), str(tmp_path / "wh")
    done = build.build(spark, str(raw), root, seeds(spark))
    assert done == {"2026-01": 2, "2026-02": 2, "placsp@2026-02-10": 1, "bdns@2026-02-10": 3, "boe@2026-02-10": 1, "consejo_ministros@2026-02-10": 2}
    w = Warehouse(spark, root)
    assert set(w.versions()) == set(TABLES)
    facts = {(r.periodo, r.economica_cod): r for r in w.read("fact_ejecucion").collect()}
    assert len(facts) == 4 and facts["2026-02", "22706"].provincia_cod == "NT" and facts["2026-02", "22706"].cobertura == "credito_inicial,credito_definitivo,orn"
    assert {r.economica_cod: r.denominacion for r in w.read("dim_economica").collect()} == {"22706": "Estudios", "2270601": "Otros", "22": None}
    assert sorted((r.periodo, r.presupuesto) for r in w.read("dim_periodo").collect()) == [("2026-01", "2026"), ("2026-02", "2026")]
    assert w.read("fact_contratos").first().anclaje_senal == "dir3_directo"
    assert {r.concesion_id: (r.anclaje_tipo, r.anclaje_senal) for r in w.read("fact_subvenciones").collect()} == {"1": ("servicio", "dir3_ancestro"), "2": ("fuera_perimetro", "no_estatal"), "3": ("sin_anclar", "organo_no_resuelto")}
    assert [(r.seccion_cod, r.anclaje_tipo) for r in w.read("fact_boe_disposiciones").collect()] == [("01", "seccion")]
    assert sorted(r.tipo_acuerdo for r in w.read("fact_acuerdos_cdm").where("seccion_cod = '01'").collect()) == ["autorizacion_gasto", "convenio"]
    before = w.versions()["fact_ejecucion"]
    # nothing new: nothing is loaded; another month: only its folder is written
    assert build.update(spark, str(raw), root, seeds(spark)) == {}
    (raw / "igae_mensual" / "2026-03").mkdir()
    workbook(raw / "igae_mensual" / "2026-03" / "MENSUAL ANEXO I.xlsx", {"S5": [["CRÉDITO"]], "S01": MONTH})
    assert build.update(spark, str(raw), root, seeds(spark)) == {"2026-03": 2}
    after = w.versions()["fact_ejecucion"]
    assert set(before) < set(after) and len(after) == 3
    # the same month again replaces its rows and no other folder
    again = igae.read_month(spark, str(raw), "2026-03", "2026-04-01")
    build.load_month(w, again)
    final = w.versions()["fact_ejecucion"]
    assert len(set(final) & set(after)) == 2 and w.read("fact_ejecucion").count() == 6
    # obligations that fall are refused, and everything stays
    state = w.versions()
    low = [[r[0], r[1], r[2], r[3], "1" if r[0] else "2"] for r in MONTH]
    (raw / "igae_mensual" / "2026-04").mkdir()
    workbook(raw / "igae_mensual" / "2026-04" / "x ANEXO I.xlsx", {"S5": [["CRÉDITO"]], "S01": low})
    with pytest.raises(RejectedLoad, match="R8"):
        build.load_month(w, igae.read_month(spark, str(raw), "2026-04", "2026-05-01"))
    assert w.versions() == state


def test_guards_of_the_month(spark, tmp_path):
    raw = tmp_path / "raw"
    folder = raw / "igae_mensual" / "2026-01"
    folder.mkdir(parents=True)
    with pytest.raises(igae.BadMonth, match="0 files"):
        igae.month_file(spark, str(raw), "2026-01")
    workbook(folder / "a ANEXO I.xlsx", {"S01": MONTH})
    with pytest.raises(igae.BadMonth, match="S5"):
        igae.read_month(spark, str(raw), "2026-01", "2026-02-01")
    workbook(folder / "a ANEXO I.xlsx", {"S5": [["x"]], "S01": [*MONTH, ["Z", "0102 911O 22706-Más", "1", "1", "1"]]})
    with pytest.raises(igae.BadMonth, match="behind"):
        igae.read_month(spark, str(raw), "2026-01", "2026-02-01")
    workbook(folder / "a ANEXO I.xlsx", {"S5": [["x"]], "S01": [*MONTH[:2], [None, "TOTAL SERVICIO", "110", "130", "99"]]})
    with pytest.raises(igae.BadMonth, match=r"34\.00"):
        igae.read_month(spark, str(raw), "2026-01", "2026-02-01")
    (folder / "b ANEXO I.csv").write_text("x")
    with pytest.raises(igae.BadMonth, match="2 files"):
        igae.month_file(spark, str(raw), "2026-01")
    (folder / "a ANEXO I.xlsx").unlink()
    (folder / "b ANEXO I.csv").write_text("sheet,pos,c0,c1,c2,c3,c4\nS01,1,Dirección,0101  911O   22706 -Estudios,100,120,60\nS01,2,,TOTAL SERVICIO,100,120,60\n")
    assert [r.economica_cod for r in igae.read_month(spark, str(raw), "2026-01", "2026-02-01").collect()] == ["22706"]


def test_orphans_contracts_and_second_writer(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path / "wh"))
    w.init()
    rows = spark.createDataFrame([(2026, "01", "01", "b"), (2026, "01", "01", "a"), (2026, "01", "02", None)], "ejercicio int, seccion_cod string, servicio_cod string, servicio_denominacion string")
    known = w.read("dim_seccion_servicio")
    assert [r.servicio_denominacion for r in build.derived_services(rows.where("servicio_cod = '01'"), known).collect()] == ["a"]
    with pytest.raises(build.OrphanError, match=r"2026/01\.02"):
        build.derived_services(rows, known)
    with pytest.raises(build.ContractError, match="forma"):
        build.shaped(spark.createDataFrame([(2026, "1", "01", "x")], rows.schema), "dim_seccion_servicio")
    other = Warehouse(spark, str(tmp_path / "wh"))
    w._number, n = (lambda: 0), w._number()
    assert n == 1
    with pytest.raises(ConcurrentLoad):
        w.commit({"dim_periodo": other.read("dim_periodo")})


def test_diagnosis_never_raises(tmp_path):
    raw = raw_folder(tmp_path)
    good = {"igae_mensual": raw / "igae_mensual" / "2026-01" / "MENSUAL 2026-01 ANEXO I.xlsx", "bdns": raw / "bdns" / "2026-02-10" / "p.json", "boe_sumario": raw / "boe" / "2026-02-10" / "20260209" / "sumario.xml", "consejo_ministros": raw / "consejo_ministros" / "2026-02-10" / "2026-02-09.html"}
    assert {s: sentinel.diagnose(s, str(p)).valid for s, p in good.items()} == dict.fromkeys(good, True)
    assert "second version" in sentinel.diagnose("placsp", str(raw / "placsp" / "2026-02-10" / "a.atom")).message
    for source in sentinel.CHECKS:
        for body in (b"", b"<html>", b"{}", b"PK\x03\x04x", bytes.fromhex("D0CF11E0A1B11AE1")):
            (tmp_path / "f").write_bytes(body)
            assert not sentinel.diagnose(source, str(tmp_path / "f")).valid
        assert not sentinel.diagnose(source, str(tmp_path / "none")).valid
    assert sentinel.diagnose("otra", "x").valid


def test_operations(spark, tmp_path):
    assert ops.execution_file("2026-04") == "MENSUAL ABRIL 2026 ANEXO I.xlsx" and ops.month_of("abril") == 4 and ops.execution_url("2026-04", "https://x/").endswith("MENSUAL%20ABRIL%202026%20ANEXO%20I.xlsx")
    df = spark.createDataFrame([(D(2026, 1, 1), "diaria", "2026-04"), (D(2026, 1, 4), "diaria", "x"), (D(2025, 12, 1), "diaria", "2026-13"), (None, "mensual", None)], "d date, c string, p string")
    got = df.select(ops.light("d", "c", ops.F.lit("2026-01-05").cast("date")).alias("l"), ops.month_column("p").alias("m"), ops.reference_url("https://x/{anio}/{fecha}.aspx", "d").alias("u")).collect()
    assert [r.l for r in got] == ["ambar", "verde", "rojo", "sin_datos"] and [r.m for r in got] == ["ABRIL", None, None, None] and got[0].u == "https://x/2026/20260101.aspx"
    led = Ledger(str(tmp_path / "l.json"), spark)
    assert ops.watched("bdns", "2026-01-01", led, lambda: 5) == 5
    with pytest.raises(igae.BadMonth):
        ops.watched("igae", "2026-01", led, lambda: (_ for _ in ()).throw(igae.BadMonth("x")))
    assert led.read()["igae"]["fallo"]["kind"] == "formato_cambiado" and "Rows: 5" in ops.run_summary(led, ["bdns"], "2026-01-01", True)
    i = ops.Incident("formato_cambiado", "igae", "2026-01", "t", "d")
    assert ops.untold([i, i], set()) == [i] and ops.untold([i], {i.fingerprint()}) == [] and "FORMATO" in i.text()
    assert ops.order(["contratos"]) == ["semillas", "dimensiones", "crosswalk", "contratos"]
    assert ops.default_partition("ejecucion", D(2026, 2, 3)) == "2026-02" and ops.default_partition("contratos", D(2026, 2, 3)) == "2026-02-03" and ops.default_partition("semillas") is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("a")
    assert ops.stale(spark, {"crosswalk": str(tmp_path / "in")}, led) == ["crosswalk", "contratos", "subvenciones", "frescura"]
    ops.made(spark, "crosswalk", str(tmp_path / "in"), led)
    assert ops.stale(spark, {"crosswalk": str(tmp_path / "in")}, led) == []


def test_build_commands(spark, tmp_path, capsys):
    raw = raw_folder(tmp_path)
    (tmp_path / "seeds").mkdir()
    for name, rows in seeds(spark).items():
        full = build.shaped(rows, name)
        build.write_seed(full, str(tmp_path / "out"))
        part = next((tmp_path / "out").glob("part*.csv"))
        (tmp_path / "seeds" / f"{name}.csv").write_text(part.read_text())
    args = [str(raw), str(tmp_path / "wh"), "--seeds", str(tmp_path / "seeds"), "--ledger", str(tmp_path / "l.json")]
    assert cli.main(["build", *args]) == 0 and json.loads(capsys.readouterr().out)["2026-02"] == 2
    assert cli.main(["update", *args]) == 0 and json.loads(capsys.readouterr().out) == {}
    assert cli.main(["materialize", "ejecucion", str(raw), str(tmp_path / "wh"), "--partition", "2026-02", "--ledger", str(tmp_path / "l.json")]) == 0
    assert cli.main(["materialize", "ejecucion", str(raw), str(tmp_path / "wh"), "--partition", "2027-02", "--ledger", str(tmp_path / "l.json")]) == 1
    assert cli.main(["summary", str(tmp_path / "l.json"), "2026-02", "--source", "igae_mensual"]) == 0 and "Rows: 2" in capsys.readouterr().out
    assert Ledger(str(tmp_path / "l.json"), spark).read()["igae_mensual"]["fallo"]["kind"] == "formato_cambiado"
