"""Monthly execution workbook: sheets of section rows to canonical execution rows, with the printed subtotals checked."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fiscalspark.files import Files
from fiscalspark.session import materialise, ship

#: First bytes of the two workbook formats.
MAGIC = {"504B0304": "ooxml", "D0CF11E0A1B11AE1": "biff"}
#: Grammar of the cells. An application is codes, economic code and label; a header is a programme code and a dash.
APPLICATION = r"^(\d{4}[\s\S]*?)\s+(\d{3,7})\s*-\s*([\s\S]+)$"
HEADER = r"^[0-9A-ZÑ]{3,4}-"
SUBTOTAL = r"(?i)^\s*TOTAL SERVICIO"
CELLS = "path string, sheet string, pos int, c0 string, c1 string, c2 string, c3 string, c4 string"
#: Euros by which a printed subtotal may differ from the sum of its rows.
TOLERANCE = 0.5


def workbook_format(content: Column) -> Column:
    """S-02: 'ooxml', 'biff' or null by the first bytes."""
    h = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(h.startswith(m), v) for m, v in MAGIC.items()])


def sheet_cells(content: bytes, width: int) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row, first ``width`` cells as text) of an OOXML workbook, read with the standard library."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{ns['m']}}}sheet"):
            target = links[sheet.get(rel)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for row in root.iter(f"{{{ns['m']}}}row"):
                cells: list[str | None] = [None] * width
                for c in row.findall("m:c", ns):
                    letters = re.match(r"[A-Z]+", c.get("r") or "A").group()
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    if at > width:
                        continue
                    v, kind = c.find("m:v", ns), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if kind == "inlineStr" else v.text if v is not None else None
                    cells[at - 1] = shared[int(text)] if kind == "s" and text is not None else text
                out.append((sheet.get("name"), int(row.get("r")), cells))
        return out


def read_cells(spark: SparkSession, path: str, wanted: str = r"^S\d{2}$", width: int = 5) -> DataFrame:
    """S-03: cells of the wanted sheets of every workbook under path. A workbook in the old binary format is an error: no reader for it is at hand."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", F.when(workbook_format(F.col("content")) == "ooxml", F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no OOXML workbook: "), "path"))).alias("content"))
    keep = re.compile(wanted)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f["path"], f["content"]):
                rows = [(p, s, r, *cells) for s, r, cells in sheet_cells(bytes(content), width) if keep.match(s)]
                yield pd.DataFrame(rows, columns=["path", "sheet", "pos", *[f"c{i}" for i in range(width)]])

    schema = "path string, sheet string, pos int, " + ", ".join(f"c{i} string" for i in range(width))
    return files.mapInPandas(read, schema)


def read_converted(spark: SparkSession, path: str) -> DataFrame:
    """S-04: cells of workbooks of the old binary format that were converted to CSV with header sheet, pos, c0 to c4, empty cells null."""
    rows = spark.read.csv(path, header=True, schema="sheet string, pos int, c0 string, c1 string, c2 string, c3 string, c4 string", mode="FAILFAST")
    return rows.select(F.col("_metadata.file_path").alias("path"), "*").where(F.col("sheet").rlike(r"^S\d{2}$"))


class BadMonth(ValueError):
    """A month's workbook is not there, not of the known shape, or does not add up."""


def month_file(spark: SparkSession, raw: str, period: str) -> str:
    """S-09: the one file of a period, 'ANEXO I' in its name, as workbook or converted CSV."""
    folder = f"{raw}/igae_mensual/{period}"
    found = [n for n in Files(spark).names(folder, folders=False) if re.search(r"ANEXO I(?!I).*\.(xlsx?|csv)$", n, re.I)]
    if len(found) != 1:
        raise BadMonth(f"{folder}: {len(found)} files of ANEXO I, one is needed")
    return f"{folder}/{found[0]}"


def check_sheets(spark: SparkSession, path: str) -> list[str]:
    """S-02: names of the sheets; the summary S5 and at least one sheet of a section must be there."""
    content = spark.read.format("binaryFile").load(path).select("content").first().content
    sheets = sorted({s for s, _, _ in sheet_cells(bytes(content), 1)} | set(sheet_names(bytes(content))))
    if "S5" not in sheets or not any(re.match(r"^S\d\d$", s) for s in sheets):
        raise BadMonth(f"{path}: sheets {', '.join(sheets)}; S5 and SNN are needed")
    return sheets


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [e.get("name") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if e.tag.endswith("}sheet")]


def read_month(spark: SparkSession, raw: str, period: str, captured: str) -> DataFrame:
    """S-02 to S-09: the canonical rows of a period, from its one file; an error where its sheets are others, a printed subtotal differs
    from its rows, or rows stand behind the last subtotal."""
    path = month_file(spark, raw, period)
    if path.lower().endswith(".csv"):
        cells = read_converted(spark, path)
    else:
        cells = read_cells(spark, path)
        check_sheets(spark, path)
    cells = materialise(cells)
    bad = [f"{r.sheet} block {r.block}: {r.diferencia:.2f}" for r in unbalanced(cells).limit(20).collect()]
    bad += [f"{r.sheet}: {r.n} rows behind the last subtotal" for r in unclosed(cells).limit(20).collect()]
    if bad:
        raise BadMonth(f"{path}: " + "; ".join(bad[:3]) + (f" and {len(bad) - 3} more" if len(bad) > 3 else ""))
    return parse(cells, period, captured)


def row_kind(cell: Column) -> Column:
    """S-05: what a row is, by its application cell."""
    t = F.coalesce(F.trim(cell), F.lit(""))
    return F.when(t == "", "SEPARADOR").when(t.rlike(SUBTOTAL), "SUBTOTAL").when(t.rlike(APPLICATION), "APLICACION").when(t.rlike(HEADER), "CABECERA").otherwise("OTRO")


def application(cell: Column) -> Column:
    """S-06: struct of section, service, province, programme, economic code and label of a composite cell."""
    t = F.trim(cell)
    packed = F.regexp_replace(F.regexp_extract(t, APPLICATION, 1), r"\s+", "")
    rest = F.substring(packed, 5, 100)
    has_province = F.length(rest) >= 6
    return F.struct(
        F.substring(packed, 1, 2).alias("seccion_cod"),
        F.substring(packed, 3, 2).alias("servicio_cod"),
        F.when(has_province, F.substring(rest, 1, 2)).alias("provincia_cod"),
        F.when(has_province, F.substring(rest, 3, 100)).otherwise(rest).alias("programa_cod"),
        F.regexp_extract(t, APPLICATION, 2).alias("economica_cod"),
        F.trim(F.regexp_extract(t, APPLICATION, 3)).alias("aplicacion_denominacion"),
    )


def cell_amount(c: Column) -> Column:
    """S-07: number of an amount cell; blank and '-' are null, any other text is an error."""
    t = F.trim(c)
    return F.when(t.isNull() | t.isin("", "-"), F.lit(None)).otherwise(F.replace(t, F.lit(","), F.lit("."))).cast("double")


def parse(cells: DataFrame, period: str, captured: str) -> DataFrame:
    """Canonical rows of the application rows of the cells."""
    a = application(F.col("c1"))
    rows = cells.where(row_kind(F.col("c1")) == "APLICACION").select("sheet", "pos", F.col("c0").alias("servicio_denominacion"), a.alias("a"), *[cell_amount(F.col(c)).alias(n) for c, n in (("c2", "credito_inicial"), ("c3", "credito_definitivo"), ("c4", "orn"))])
    return rows.select(F.lit(period).alias("periodo"), F.lit("igae_anexo_i").alias("fuente_cod"), F.lit(captured).cast("date").alias("fecha_captura"), "a.*", "servicio_denominacion", "credito_inicial", "credito_definitivo", "orn")


def unbalanced(cells: DataFrame) -> DataFrame:
    """S-08: printed subtotals that differ from the sum of the application rows since the subtotal before; blocks by a running
    count of subtotals within the sheet."""
    kind = row_kind(F.col("c1"))
    w = Window.partitionBy("path", "sheet").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("kind", kind).where("kind IN ('APLICACION', 'SUBTOTAL')").withColumn("block", F.coalesce(F.sum(F.when(F.col("kind") == "SUBTOTAL", 1).otherwise(0)).over(w), F.lit(0)))
    sums = []
    for c in ("c2", "c3", "c4"):
        x = cell_amount(F.col(c))
        sums += [F.coalesce(F.sum(F.when(F.col("kind") == "APLICACION", x)), F.lit(0.0)).alias(f"{c}_filas"), F.coalesce(F.max(F.when(F.col("kind") == "SUBTOTAL", x)), F.lit(0.0)).alias(f"{c}_total")]
    per = rows.groupBy("path", "sheet", "block").agg(F.max(F.when(F.col("kind") == "SUBTOTAL", 1)).alias("cerrado"), *sums)
    off = F.greatest(*[F.abs(F.col(f"{c}_filas") - F.col(f"{c}_total")) for c in ("c2", "c3", "c4")])
    return per.where("cerrado = 1").withColumn("diferencia", off).where(F.col("diferencia") > TOLERANCE)


def unclosed(cells: DataFrame) -> DataFrame:
    """S-08: sheets with application rows that no subtotal follows, and their number."""
    rows = cells.withColumn("kind", row_kind(F.col("c1"))).where("kind IN ('APLICACION', 'SUBTOTAL')")
    last = rows.groupBy("path", "sheet").agg(F.coalesce(F.max(F.when(F.col("kind") == "SUBTOTAL", F.col("pos"))), F.lit(-1)).alias("last"))
    return rows.join(last, ["path", "sheet"]).where("kind = 'APLICACION' AND pos > last").groupBy("path", "sheet").agg(F.count("*").alias("n"))
