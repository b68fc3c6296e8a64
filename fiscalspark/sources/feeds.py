"""Contracts feed (Atom, plain or in ZIP files), grant pages (JSON), gazette (XML), cabinet references (HTML), budget and unit lists."""

from __future__ import annotations

import html
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.functions import text
from fiscalspark.operators.latest import latest_block, latest_by
from fiscalspark.session import materialise, ship
from fiscalspark.sources.igae import read_cells

#: Largest member of a ZIP file that is read.
MEMBER_BYTES = 2 << 30
CONTRACT = (
    "path string, pos int, licitacion_id string, lote_id string, es_cabecera_expediente boolean, expediente_id string, estado_cod string, organo_id string, organo_id_esquema string, organo_denominacion string, tipo_contrato_cod string, "
    "procedimiento_cod string, cpv_cod string, presupuesto_sin_iva string, presupuesto_con_iva string, valor_estimado string, importe_adjudicacion string, num_ofertas string, resultado_cod string, adjudicatario_id string, adjudicatario_nombre string, "
    "adjudicatario_es_pyme string, fecha_adjudicacion string, fecha_formalizacion string, fecha_actualizacion string"
)


#: Namespaces of the feed and of the contract notices.
ATOM, CODICE, CODICE2 = "http://www.w3.org/2005/Atom", r"CommonBasicComponents-\d", "urn:dgpe:names:draft:codice:schema:xsd:CommonBasicComponents-2"


def local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def walk(e: ET.Element | None, *names: str) -> ET.Element | None:
    """First descendant along the local names, whatever their namespaces."""
    for n in names:
        e = next((c for c in e if local(c) == n), None) if e is not None else None
    return e


def deep(e: ET.Element | None, name: str) -> ET.Element | None:
    """First element of that local name anywhere below e."""
    return next((x for x in e.iter() if local(x) == name), None) if e is not None else None


def said(e: ET.Element | None) -> str | None:
    t = (e.text or "").strip() if e is not None else ""
    return t or None


def contract_rows(entry: ET.Element) -> list[dict]:
    """S-11 to S-14: rows of an Atom entry: one per result, one head row where there is none; lot ids made unique by place."""
    folder = deep(entry, "ContractFolderStatus")
    ident = said(walk(entry, "id")) or ""
    tender = ident.rstrip("/").rsplit("/", 1)[-1]
    party = deep(walk(folder, "LocatedContractingParty"), "Party")
    party_id = deep(walk(party, "PartyIdentification"), "ID")
    organ, file = said(party_id), said(walk(folder, "ContractFolderID"))
    project, budget = walk(folder, "ProcurementProject"), walk(folder, "ProcurementProject", "BudgetAmount")
    head = {
        "licitacion_id": tender or f"{organ or 'SIN_ORGANO'}::{file}", "expediente_id": file, "estado_cod": said(walk(folder, "ContractFolderStatusCode")), "organo_id": organ,
        "organo_id_esquema": party_id.get("schemeName") if party_id is not None else None, "organo_denominacion": said(deep(walk(party, "PartyName"), "Name")), "tipo_contrato_cod": said(walk(project, "TypeCode")),
        "procedimiento_cod": said(walk(folder, "TenderingProcess", "ProcedureCode")), "cpv_cod": said(deep(walk(project, "RequiredCommodityClassification"), "ItemClassificationCode")), "fecha_actualizacion": said(walk(entry, "updated")),
        "fecha_formalizacion": said(deep(folder, "IssueDate")),
    }
    amounts = {"presupuesto_sin_iva": said(walk(budget, "TaxExclusiveAmount")), "presupuesto_con_iva": said(walk(budget, "TotalAmount")), "valor_estimado": said(walk(budget, "EstimatedOverallContractAmount"))}
    results = [c for c in folder if local(c) == "TenderResult"] if folder is not None else []
    if not results:
        return [head | amounts | {"lote_id": "0", "es_cabecera_expediente": True}]
    out, used = [], set()
    for i, r in enumerate(results):
        project = walk(r, "AwardedTenderedProject")
        lot = said(walk(project, "ProcurementProjectLotID")) or ("0" if len(results) == 1 else f"s{i + 1}")
        if lot in used:
            lot = f"{lot}.{i + 1}"
        used.add(lot)
        winner = walk(r, "WinningParty")
        out.append(
            head
            | (amounts if i == 0 else {})
            | {
                "lote_id": lot, "es_cabecera_expediente": i == 0, "resultado_cod": said(walk(r, "ResultCode")), "num_ofertas": said(walk(r, "ReceivedTenderQuantity")), "fecha_adjudicacion": said(walk(r, "AwardDate")),
                "adjudicatario_id": said(deep(walk(winner, "PartyIdentification"), "ID")), "adjudicatario_nombre": said(deep(walk(winner, "PartyName"), "Name")), "adjudicatario_es_pyme": said(walk(r, "SMEAwardedIndicator")),
                "importe_adjudicacion": said(deep(walk(project, "LegalMonetaryTotal"), "TaxExclusiveAmount")),
            }
        )
    return out


def feed_rows(content: bytes) -> list[dict]:
    """Rows of an Atom feed in document order; a tombstone gives one row in state BAJA."""
    root = ET.fromstring(content)
    if root.tag != f"{{{ATOM}}}feed":
        raise ValueError(f"no Atom feed: {root.tag}")
    spaces = {e.tag[1:].split("}")[0] for e in root.iter() if e.tag.startswith("{")}
    if any(re.search(CODICE, x) for x in spaces) and CODICE2 not in spaces:
        raise ValueError(f"no contract notices of the second version: {', '.join(sorted(spaces))}")
    out: list[dict] = []
    for e in root:
        if local(e) == "entry":
            out += contract_rows(e)
        elif local(e) == "deleted-entry":
            out.append({"licitacion_id": (e.get("ref") or "").rstrip("/").rsplit("/", 1)[-1], "lote_id": "0", "es_cabecera_expediente": True, "estado_cod": "BAJA", "fecha_actualizacion": e.get("when")})
    return out


def day(c: Column | str) -> Column:
    """F-12: date from the front of a text; null if there is none."""
    return F.substring(c, 1, 10).try_cast("date")


def read_contracts(spark: SparkSession, path: str, captured: str) -> DataFrame:
    """S-10 to S-16: canonical contract rows of the feeds under path; of each tender the last photo in reading order counts (W-04, W-06)."""
    ship(spark)
    names = [c.split()[0] for c in CONTRACT.split(", ")]

    def members(p: str, content: bytes) -> Iterator[tuple[str, bytes]]:
        if content[:4] != b"PK\x03\x04":
            yield p, content
            return
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in sorted(z.namelist()):
                if m.endswith(".atom"):
                    if z.getinfo(m).file_size > MEMBER_BYTES:
                        raise ValueError(f"{p}: {m} is too large")
                    yield f"{p}!{m}", z.read(m)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                for name, body in members(p, bytes(content)):
                    rows = [r | {"path": name, "pos": i} for i, r in enumerate(feed_rows(body))]
                    yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in names})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CONTRACT)
    num = lambda c: F.col(c).try_cast("double").alias(c)
    rows = raw.select(
        "path", "pos", "licitacion_id", "lote_id", "es_cabecera_expediente", "expediente_id", "estado_cod", "organo_id", "organo_id_esquema", F.when(F.upper("organo_id_esquema") == "DIR3", F.upper("organo_id")).alias("organo_dir3_cod"),
        "organo_denominacion", "tipo_contrato_cod", "procedimiento_cod", "cpv_cod", *[num(c) for c in ("presupuesto_sin_iva", "presupuesto_con_iva", "valor_estimado", "importe_adjudicacion")], "num_ofertas", "resultado_cod", "adjudicatario_id",
        "adjudicatario_nombre", F.when(F.col("adjudicatario_es_pyme").isNotNull(), F.lower("adjudicatario_es_pyme") == "true").alias("adjudicatario_es_pyme"), *[day(c).alias(c) for c in ("fecha_adjudicacion", "fecha_formalizacion", "fecha_actualizacion")],
    )
    last = latest_block(rows, "licitacion_id", ["path", "pos"], "fecha_actualizacion")
    award = F.max("fecha_adjudicacion").over(Window.partitionBy("licitacion_id"))
    return last.withColumn("fecha_captura", F.lit(captured).cast("date")).withColumn("periodo", F.date_format(F.coalesce(award, "fecha_actualizacion", "fecha_captura"), "yyyy-MM")).drop("path", "pos")


GRANT = (
    "content array<struct<id:long,codConcesion:string,fechaConcesion:string,fechaAlta:string,beneficiario:string,idPersona:string,instrumento:string,importe:double,ayudaEquivalente:double,urlBR:string,tieneProyecto:boolean,"
    "numeroConvocatoria:string,idConvocatoria:string,convocatoria:string,nivel1:string,nivel2:string,nivel3:string,codigoInvente:string>>"
)


def read_grants(spark: SparkSession, path: str, captured: str) -> DataFrame:
    """S-17, S-18, W-05: canonical grants of the JSON pages under path; of each grant the newest registration counts, then the later place.

    A page without its list is an error.
    """
    pages = spark.read.schema(GRANT).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("path"), "content")
    pages = pages.withColumn("content", F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no grants in "), "path"))).otherwise(F.col("content")))
    g = pages.select("path", F.posexplode("content").alias("pos", "g")).where("g IS NOT NULL")
    b = text.beneficiary("g.beneficiario")
    rows = g.select(
        F.col("g.id").cast("string").alias("concesion_id"), "path", "pos", F.nullif(F.trim("g.codConcesion"), F.lit("")).alias("concesion_cod"), F.col("g.idConvocatoria").alias("convocatoria_id"), F.col("g.numeroConvocatoria").alias("convocatoria_cod"),
        F.col("g.convocatoria").alias("convocatoria_titulo"), *[F.nullif(F.trim(f"g.{c}"), F.lit("")).alias(c) for c in ("nivel1", "nivel2", "nivel3", "instrumento")], F.col("g.codigoInvente").alias("codigo_invente"), F.col("g.importe").alias("importe"),
        F.col("g.ayudaEquivalente").alias("ayuda_equivalente"), F.col("g.idPersona").alias("beneficiario_id"), b["nif"].alias("beneficiario_nif"), b["nombre"].alias("beneficiario_nombre"), b["tipo"].alias("beneficiario_tipo"),
        F.col("g.tieneProyecto").alias("tiene_proyecto"), F.col("g.urlBR").alias("url_br"), day("g.fechaConcesion").alias("fecha_concesion"), day("g.fechaAlta").alias("fecha_alta"), F.lit(captured).cast("date").alias("fecha_captura"),
    )
    w = Window.partitionBy("concesion_id").orderBy(F.desc_nulls_last("fecha_alta"), F.desc("path"), F.desc("pos"))
    one = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "path", "pos")
    return one.withColumn("periodo", F.date_format(F.coalesce("fecha_concesion", "fecha_alta", "fecha_captura"), "yyyy-MM"))


#: Gazette sections, and words of titles, that matter.
GAZETTE_SECTIONS = ("1", "3", "5B")
#: Fixed value: number of the grants' call that a provision names.
GRANT_CALL = r"(?i)BDNS\s*\(\s*Identif\.?\s*\)\s*:?\s*(\d+)"
GAZETTE_TITLES = r"(?i)subvenci|ayuda|cr[eé]dito|convoca"


def read_gazette(spark: SparkSession, summaries: str | tuple[str, str], provisions: str | tuple[str, str], captured: str) -> DataFrame:
    """S-19 to S-21: provisions of the daily summaries, with text, class and amount where the provision's file is there.

    summaries, provisions: a path, or a folder and a pattern of the names in and below it. Items stand under a department or a
    heading of it. A summary row without file is kept with null text.
    """
    ship(spark)

    def items(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for content in f["content"]:
                root = ET.fromstring(bytes(content))
                date = next((x.text or x.get("fecha") for x in root.iter() if local(x) in ("fecha", "fecha_publicacion") and (x.text or "").strip()), None)
                for s in (x for x in root.iter() if local(x) == "seccion"):
                    for d in (x for x in s.iter() if local(x) == "departamento"):
                        for i in (x for x in d.iter() if local(x) == "item"):
                            out.append((date, s.get("codigo") or s.get("num"), d.get("nombre"), said(walk(i, "identificador")) or i.get("id"), said(walk(i, "titulo"))))
            yield pd.DataFrame(out, columns=["dia", "seccion_boe", "departamento", "identificador", "titulo"])

    def bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for content in f["content"]:
                root = ET.fromstring(bytes(content))
                kind = deep(deep(root, "analisis"), "tipo")
                t = " ".join(" ".join("".join(p.itertext()).split()) for p in root.iter() if local(p) == "p")
                out.append((said(deep(root, "identificador")), kind.get("codigo") if kind is not None else None, t or None))
            yield pd.DataFrame(out, columns=["identificador", "tipo", "texto"])

    def load(p: str | tuple[str, str]) -> DataFrame:
        folder, names = p if isinstance(p, tuple) else (p, "*")
        return spark.read.format("binaryFile").option("recursiveFileLookup", isinstance(p, tuple)).option("pathGlobFilter", names).load(folder).select("content")

    s = load(summaries).mapInPandas(items, "dia string, seccion_boe string, departamento string, identificador string, titulo string")
    s = s.where(F.col("seccion_boe").isin(*GAZETTE_SECTIONS) & F.col("titulo").rlike(GAZETTE_TITLES) & F.col("identificador").isNotNull())
    p = load(provisions).mapInPandas(bodies, "identificador string, tipo string, texto string")
    # an item that several summaries name counts by the latest day, a provision that comes twice by its longest text (W-06)
    s = latest_by(s, ["identificador"], ["dia", "titulo"])
    p = latest_by(p.where("identificador IS NOT NULL").withColumn("largo", F.length("texto")), ["identificador"], ["largo", "texto"]).drop("largo")
    j = s.join(p, "identificador", "left")
    a = text.amount("texto")
    date = F.coalesce(F.try_to_date("dia", "yyyyMMdd"), day("dia"))
    return j.select(
        "identificador", date.alias("fecha"), F.date_format(F.coalesce(date, F.lit(captured).cast("date")), "yyyy-MM").alias("periodo"), "seccion_boe", "departamento", "titulo", text.gazette_class("titulo", F.col("tipo")).alias("tipo_disposicion"),
        F.nullif(F.regexp_extract("texto", GRANT_CALL, 1), F.lit("")).alias("bdns_id"), a["importe"].alias("importe"), a["confianza"].alias("importe_confianza"), F.col("texto").alias("texto_bruto"), F.lit(captured).cast("date").alias("fecha_captura"),
    )


#: Headings (normalised) that open and close the summary of a cabinet reference, and those of personnel matters.
OPENS, CLOSES, PERSONNEL = r"^sumario", r"^ampliacion de contenido|^biografia|mas informacion", r"^acuerdos de personal|^condecoraciones|^personal$|nombramiento"


def read_cabinet_capture(spark: SparkSession, path: str, captured: str) -> DataFrame:
    """S-22, S-23: agreements of a capture's references, innermost items only; an error if no page has any. A page that has none is passed over."""
    rows = materialise(read_cabinet(spark, path, captured, leaves=True))
    if rows.isEmpty():
        raise ValueError(f"no cabinet reference can be read under {path}")
    return rows


def read_cabinet(spark: SparkSession, path: str, captured: str, leaves: bool = False) -> DataFrame:
    """S-22, S-23, W-10: agreements of the cabinet references under path, one per list item of the summary, in document order.

    Headings and items become rows with their place; the ministry is the last heading before an item (last non-null over the
    rows up to it), the summary's bounds are running maxima. With leaves an item that holds a list is no
    agreement, only its items are. A page without summary gives no rows. The day is read from the file name or its folder's.
    """
    ship(spark)
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("v"))
    # a list within an item is kept as a mark at its end
    tags = F.regexp_extract_all("v", F.lit(r"(?is)(<(?:h2|h3|li)\b[^>]*>(?:(?!<(?:h2|h3|li|ul|ol)\b|</(?:h2|h3|li)>).)*(?:<(?=[uo]l\b))?)"), 1)
    rows = pages.select("path", F.posexplode(tags).alias("pos", "x")).withColumn("tag", F.lower(F.regexp_extract("x", r"^<(\w+)", 1)))

    @F.pandas_udf("string")
    def visible(s: pd.Series) -> pd.Series:
        return s.map(lambda x: re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip())

    rows = rows.where(~((F.col("tag") == "li") & F.col("x").endswith("<"))) if leaves else rows.withColumn("x", F.regexp_replace("x", "<$", ""))
    t = rows.withColumn("t", visible("x")).where("t <> ''").withColumn("n", text.normal("t"))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.col("tag").isin("h2", "h3")
    inside = t.withColumn("open", F.max(F.when(heading & F.col("n").rlike(OPENS), 1).otherwise(0)).over(w))
    inside = inside.withColumn("closed", F.max(F.when((F.col("open") == 1) & heading & F.col("n").rlike(CLOSES), 1).otherwise(0)).over(w)).where("open = 1 AND closed = 0")
    carried = inside.withColumn("head", F.last(F.when(F.col("tag") == "h3", F.col("t")), ignorenulls=True).over(w)).withColumn("personnel", F.coalesce(F.last(F.when(heading, F.col("n").rlike(PERSONNEL)), ignorenulls=True).over(w), F.lit(False)))
    date = F.coalesce(F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1)), F.try_to_date(F.regexp_extract("path", r"/(\d{8})/[^/]*$", 1), "yyyyMMdd"), F.lit(captured).cast("date"))
    items = carried.where("tag = 'li'").withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1).withColumn("fecha", date)
    a = text.amount("t")
    return items.select(F.concat(F.date_format("fecha", "yyyy-MM-dd"), F.lit("#"), F.lpad(F.col("i").cast("string"), 3, "0")).alias("acuerdo_id"), "fecha", F.date_format("fecha", "yyyy-MM").alias("periodo"), F.when(~F.col("personnel"), F.col("head")).alias("ministerio"), F.col("t").alias("descripcion"), text.cabinet_class("t", F.col("personnel")).alias("tipo_acuerdo"), a["importe"].alias("importe"), a["confianza"].alias("importe_confianza"), F.lit(captured).cast("date").alias("fecha_captura"))


def read_budget_services(spark: SparkSession, path: str, year: int) -> DataFrame:
    """S-25: sections (NN) and services (NN.NN) of the budget's list, a CSV in Latin-1 with semicolons; the label of the budget anywhere in it."""
    raw = spark.read.csv(path, sep=";", encoding="ISO-8859-1", schema="a string, b string, c string")
    label = raw.select(F.regexp_extract(F.concat_ws(" ", "a", "b", "c"), r"\b(\d{4}-?P?)\b", 1).alias("l")).where("l RLIKE 'P$'").agg(F.max("l").alias("l"))
    code = F.trim("a")
    sections = raw.where(code.rlike(r"^\d{2}$")).select(code.alias("seccion_cod"), F.trim("b").alias("seccion_denominacion"))
    services = raw.where(code.rlike(r"^\d{2}\.\d{2}$")).select(F.substring(code, 1, 2).alias("seccion_cod"), F.substring(code, 4, 2).alias("servicio_cod"), F.trim("b").alias("servicio_denominacion"))
    j = services.join(sections, "seccion_cod", "left").withColumn("u", F.lit(1)).join(label.withColumn("u", F.lit(1)), "u").drop("u")
    return j.select(F.lit(year).alias("ejercicio"), F.coalesce("l", F.lit(str(year))).alias("presupuesto"), "seccion_cod", "seccion_denominacion", "servicio_cod", "servicio_denominacion")


def short_date(c: Column, this_year: int) -> Column:
    """S-24: DD/MM/YY with the century that does not lie in the future."""
    d = F.try_to_date(c, "dd/MM/yy")
    return F.when(F.year(d) > this_year, F.add_months(d, -1200)).otherwise(d)


def read_units(spark: SparkSession, path: str, this_year: int) -> DataFrame:
    """S-24: organic units of the directory's workbook, sixteen columns by position under a header row."""
    c = read_cells(spark, path, wanted=r".*", width=16).where(F.upper(F.trim("c0")).rlike(r"^[A-Z]{1,2}\d{7,8}$"))
    return c.select(F.upper(F.trim("c0")).alias("dir3_cod"), F.col("c1").alias("denominacion"), F.col("c2").alias("estado"), F.col("c3").try_cast("int").alias("nivel_jerarquico"), F.upper(F.trim("c4")).alias("dir3_padre_cod"), F.col("c5").alias("tipo_entidad"), short_date(F.col("c6"), this_year).alias("fecha_alta"))


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S-26: a seed CSV with header; '#' opens a comment, codes stay text, a row of another shape is an error."""
    return spark.read.csv(path, header=True, schema=schema, comment="#", mode="FAILFAST")
