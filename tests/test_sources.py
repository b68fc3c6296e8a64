from __future__ import annotations

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fiscalspark.sources import feeds, igae

BOOK = '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{0}</sheets></workbook>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{0}</Relationships>'


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", BOOK.format("".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))))
        z.writestr("xl/_rels/workbook.xml.rels", RELS.format("".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))))
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for r, cells in enumerate(rows, 1):
                body += f'<row r="{r}">' + "".join(f'<c r="{chr(65 + k)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(cells) if v is not None) + "</row>"
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_workbook_to_rows_and_subtotals(spark, tmp_path):
    rows = [
        ["Dirección", "911O-ALTA DIRECCION"],
        ["Dirección", "0101  911O   22706 -Estudios", "100,5", "120", "60"],
        ["Dirección", "0101 911O 2270601-Otros", "-", "10", "5"],
        [None, None],
        [None, "TOTAL SERVICIO", "100,5", "130", "65"],
        ["Otra", "0102 120111142A 130 -9 cosas", "1", "2", "3"],
        [None, "TOTAL SERVICIO", "1", "2", "9"],
    ]
    workbook(tmp_path / "a.xlsx", {"S5": [["x"]], "S01": rows})
    cells = igae.read_cells(spark, str(tmp_path / "a.xlsx"))
    got = {r.economica_cod: r for r in igae.parse(cells, "2026-03", "2026-04-01").collect()}
    assert set(got) == {"22706", "2270601", "130"}
    assert (got["22706"].seccion_cod, got["22706"].servicio_cod, got["22706"].programa_cod, got["22706"].provincia_cod, got["22706"].credito_inicial) == ("01", "01", "911O", None, 100.5)
    assert got["2270601"].credito_inicial is None
    assert (got["130"].provincia_cod, got["130"].programa_cod, got["130"].aplicacion_denominacion) == ("12", "0111142A", "9 cosas")
    bad = igae.unbalanced(cells).collect()
    assert [(r.block, r.diferencia) for r in bad] == [(1, 6.0)]


def test_old_workbook_is_an_error(spark, tmp_path):
    (tmp_path / "a.xls").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    with pytest.raises(Exception, match="no OOXML"):
        igae.read_cells(spark, str(tmp_path)).collect()


@pytest.mark.parametrize(("cell", "want"), [(None, "SEPARADOR"), (" ", "SEPARADOR"), ("TOTAL SERVICIO", "SUBTOTAL"), ("1501  923M  22501 -t", "APLICACION"), ("923M-Gestión", "CABECERA"), ("nota", "OTRO")])
def test_row_kind(spark, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(igae.row_kind(F.col("c")).alias("k")).first().k == want


ENTRY = """<entry><id>https://x/{id}</id><updated>{up}T10:00:00</updated><ContractFolderStatus><ContractFolderID>E1</ContractFolderID><ContractFolderStatusCode>{st}</ContractFolderStatusCode>
<LocatedContractingParty><Party><PartyIdentification><ID schemeName="DIR3">e00000001</ID></PartyIdentification><PartyName><Name>Órgano</Name></PartyName></Party></LocatedContractingParty>
<ProcurementProject><TypeCode>2</TypeCode><BudgetAmount><TaxExclusiveAmount>1000.5</TaxExclusiveAmount><TotalAmount>bad</TotalAmount></BudgetAmount></ProcurementProject>{results}</ContractFolderStatus></entry>"""
RESULT = """<TenderResult><ResultCode>8</ResultCode><AwardDate>{day}</AwardDate><SMEAwardedIndicator>True</SMEAwardedIndicator><WinningParty><PartyIdentification><ID>A1</ID></PartyIdentification><PartyName><Name>N</Name></PartyName></WinningParty>
<AwardedTenderedProject>{lot}<LegalMonetaryTotal><TaxExclusiveAmount>{imp}</TaxExclusiveAmount></LegalMonetaryTotal></AwardedTenderedProject></TenderResult>"""


def feed(*entries):
    return '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entries) + "</feed>"


def test_contracts_feed(spark, tmp_path):
    two = ENTRY.format(id="10", up="2026-02-01", st="RES", results=RESULT.format(day="2026-01-15", lot="<ProcurementProjectLotID>1</ProcurementProjectLotID>", imp=10) + RESULT.format(day="2026-01-20", lot="<ProcurementProjectLotID>1</ProcurementProjectLotID>", imp=20))
    old = ENTRY.format(id="11", up="2026-01-01", st="PUB", results=RESULT.format(day="2026-01-02", lot="", imp=1) * 2)
    new = ENTRY.format(id="11", up="2026-03-01", st="RES", results=RESULT.format(day="2026-02-28", lot="", imp=3))
    none = ENTRY.format(id="12", up="2026-02-05", st="PUB", results="")
    gone = '<deleted-entry ref="https://x/13" when="2026-02-07T00:00:00"/>'
    (tmp_path / "a.atom").write_text(feed(two, old, none))
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("c.atom", feed(new, gone))
        z.writestr("skip.txt", "x")
    got = {(r.licitacion_id, r.lote_id): r for r in feeds.read_contracts(spark, str(tmp_path), "2026-04-01").collect()}
    assert set(got) == {("10", "1"), ("10", "1.2"), ("11", "0"), ("12", "0"), ("13", "0")}
    a, b = got["10", "1"], got["10", "1.2"]
    assert (a.es_cabecera_expediente, b.es_cabecera_expediente, a.presupuesto_sin_iva, b.presupuesto_sin_iva, a.presupuesto_con_iva) == (True, False, 1000.5, None, None)
    assert (a.periodo, got["12", "0"].periodo, a.organo_dir3_cod, a.adjudicatario_es_pyme) == ("2026-01", "2026-02", "E00000001", True)
    assert (got["11", "0"].importe_adjudicacion, got["13", "0"].estado_cod) == (3.0, "BAJA")


def test_grant_pages(spark, tmp_path):
    g = {"id": 1, "codConcesion": "SB1", "fechaConcesion": "2026-01-05", "fechaAlta": "2026-01-06", "beneficiario": "A1234567B ACME", "importe": 10.0, "nivel1": "ESTADO", "nivel2": " "}
    (tmp_path / "p1.json").write_text(json.dumps({"content": [g, g | {"id": 2, "fechaConcesion": None}]}))
    (tmp_path / "p2.json").write_text(json.dumps({"content": [g | {"importe": 99.0, "fechaAlta": "2026-02-01"}]}))
    got = {r.concesion_id: r for r in feeds.read_grants(spark, str(tmp_path), "2026-04-01").collect()}
    assert (got["1"].importe, got["1"].beneficiario_nif, got["1"].nivel2, got["2"].periodo) == (99.0, "A1234567B", None, "2026-01")
    (tmp_path / "p3.json").write_text("{}")
    with pytest.raises(Exception, match="no grants"):
        feeds.read_grants(spark, str(tmp_path), "2026-04-01").collect()


def test_gazette(spark, tmp_path):
    item = "<item><identificador>{0}</identificador><titulo>{1}</titulo></item>"
    (tmp_path / "s").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "s" / "d.xml").write_text(
        f'<sumario><metadatos><fecha>20260301</fecha></metadatos><diario><seccion codigo="1"><departamento nombre="M1">{item.format("A1", "Concesión directa de una subvención")}<epigrafe>{item.format("A2", "Orden por la que se convocan ayudas")}</epigrafe></departamento></seccion>'
        f'<seccion codigo="2"><departamento nombre="M2">{item.format("A3", "Ayudas")}</departamento></seccion></diario></sumario>'
    )
    (tmp_path / "p" / "A1.xml").write_text('<documento><metadatos><identificador>A1</identificador></metadatos><analisis><tipo codigo="9"/></analisis><texto><p>BDNS(Identif.): 742455</p><p>Importe de 1.000,5 euros</p></texto></documento>')
    got = {r.identificador: r for r in feeds.read_gazette(spark, str(tmp_path / "s"), str(tmp_path / "p"), "2026-03-02").collect()}
    assert set(got) == {"A1", "A2"}
    assert (got["A1"].tipo_disposicion, got["A1"].bdns_id, got["A1"].importe, got["A1"].fecha) == ("subvencion_directa", "742455", 1000.5, dt.date(2026, 3, 1))
    assert (got["A2"].departamento, got["A2"].texto_bruto, got["A2"].importe_confianza) == ("M1", None, "sin_importe")


def test_cabinet(spark, tmp_path):
    (tmp_path / "2026-03-10.html").write_text(
        "<h1>x</h1><ul><li>menu</li></ul><h2>SUMARIO</h2><h3>Hacienda</h3><ul><li>ACUERDO por el que se autoriza un gasto por importe de 2.000 euros</li><li>Bloque<ul><li>CONVENIO con B&eacute;lgica</li></ul></li></ul>"
        "<h3>Acuerdos de personal</h3><ul><li>Nombramiento de X</li></ul><h2>AMPLIACIÓN DE CONTENIDOS</h2><ul><li>fuera</li></ul>"
    )
    (tmp_path / "2026-03-11.html").write_text("<p>nada</p>")
    got = feeds.read_cabinet(spark, str(tmp_path), "2026-04-01").orderBy("acuerdo_id").collect()
    assert [r.tipo_acuerdo for r in got] == ["autorizacion_gasto", "otro", "convenio", "personal"]
    assert (got[0].acuerdo_id, got[0].importe, got[0].ministerio, got[2].descripcion, got[3].ministerio) == ("2026-03-10#000", 2000.0, "Hacienda", "CONVENIO con Bélgica", None)


def test_budget_list_and_units(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Presupuesto 2025-P;;\n01;Casa;\n01.02;Señales;\n02.01;Sin sección;\n", encoding="latin-1")
    got = {(r.seccion_cod, r.servicio_cod): r for r in feeds.read_budget_services(spark, str(tmp_path / "b.csv"), 2026).collect()}
    assert (got["01", "02"].presupuesto, got["01", "02"].servicio_denominacion, got["01", "02"].seccion_denominacion, got["02", "01"].seccion_denominacion) == ("2025-P", "Señales", "Casa", None)
    workbook(tmp_path / "u.xlsx", {"Unidades": [["Código", "Nombre"], ["e00000001", "Ministerio", "V", "1", None, "MN", "01/02/95"], ["E00000002", "DG", "E", "2", "e00000001", None, "03/04/21"]]})
    units = {r.dir3_cod: r for r in feeds.read_units(spark, str(tmp_path / "u.xlsx"), 2026).collect()}
    assert (units["E00000001"].fecha_alta, units["E00000002"].fecha_alta, units["E00000002"].dir3_padre_cod) == (dt.date(1995, 2, 1), dt.date(2021, 4, 3), "E00000001")


def test_seed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("cod,nota\n# comentario\n01,a\n")
    assert [tuple(r) for r in feeds.read_seed(spark, str(tmp_path / "s.csv"), "cod string, nota string").collect()] == [("01", "a")]
