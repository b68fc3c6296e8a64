"""Diagnosis of a source's file before it is read (S-27): what it is, or what about it is not as expected. It never raises."""

from __future__ import annotations

import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from fiscalspark.sources import feeds, igae

#: Keys that every grant of a page has.
GRANT_KEYS = {"id", "fechaConcesion", "beneficiario", "importe"}


@dataclass(frozen=True)
class Diagnosis:
    source: str
    valid: bool
    message: str = ""
    details: dict = field(default_factory=dict)


class _Unexpected(Exception):
    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


def _expect(ok: bool, message: str, **details) -> None:
    if not ok:
        raise _Unexpected(message, **details)


def _xml(body: bytes) -> ET.Element:
    _expect(body.lstrip()[:5] == b"<?xml" or body.lstrip()[:1] == b"<", "no XML; perhaps a page with an error", start=body[:10].hex())
    return ET.fromstring(body)


def _execution(path: Path) -> dict:
    body = path.read_bytes()
    kind = next((v for m, v in igae.MAGIC.items() if body[:8].hex().upper().startswith(m)), None)
    _expect(kind is not None, "neither of the workbook formats", start=body[:4].hex())
    _expect(kind == "ooxml", "workbook of the old binary format: convert it to CSV", kind=kind)
    names = igae.sheet_names(body)
    _expect("S5" in names, "no summary sheet S5; a new layout?", sheets=names[:10])
    sections = [n for n in names if re.match(r"^S\d\d$", n)]
    _expect(bool(sections), "no sheet of a section (SNN)", sheets=names[:10])
    top = [c for s, r, cells in igae.sheet_cells(body, 8) if s == "S5" and r <= 3 for c in cells if c]
    _expect(any(re.search(r"CR[EÉ]DITO", c, re.I) for c in top), "S5 has no heading of appropriations in its first rows", sheets=names[:10])
    return {"kind": kind, "sections": len(sections)}


def _contracts(path: Path) -> dict:
    body = path.read_bytes()
    if body[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(body)) as z:
            inside = [n for n in sorted(z.namelist()) if n.lower().endswith(".atom")]
            _expect(bool(inside), "archive without feeds", members=z.namelist()[:10])
            body = z.read(inside[0])
    root = _xml(body)
    _expect(root.tag == f"{{{feeds.ATOM}}}feed", "root is no Atom feed", root=root.tag)
    spaces = sorted({v for _, (_, v) in ET.iterparse(io.BytesIO(body), events=("start-ns",))})
    _expect(feeds.CODICE2 in spaces, "no contract notices of the second version; a new version?", namespaces=spaces[:10])
    kinds = [feeds.local(e) for e in root]
    _expect("entry" in kinds or "deleted-entry" in kinds, "empty feed")
    return {"entries": kinds.count("entry"), "tombstones": kinds.count("deleted-entry")}


def _grants(path: Path) -> dict:
    page = json.loads(path.read_text(encoding="utf-8"))
    _expect(isinstance(page, dict), "page is no object")
    _expect("content" in page, "no list of grants", keys=sorted(page)[:10])
    rows = page["content"]
    _expect(isinstance(rows, list), "content is no list")
    if rows:
        _expect(isinstance(rows[0], dict), "grants are no objects")
        lacking = GRANT_KEYS - set(rows[0])
        _expect(not lacking, f"grants lack {', '.join(sorted(lacking))}", keys=sorted(rows[0])[:15])
    return {"items": len(rows)}


def _gazette(path: Path) -> dict:
    root = _xml(path.read_bytes())
    names = {feeds.local(e) for e in root.iter()}
    if {"sumario", "diario"} <= names:
        _expect("seccion" in names, "summary without sections")
        _expect("departamento" in names, "sections without departments")
        return {"kind": "sumario", "sections": sum(feeds.local(e) == "seccion" for e in root.iter())}
    _expect({"documento", "metadatos"} <= names, "neither summary nor provision", root=root.tag)
    return {"kind": "disposicion"}


def _cabinet(path: Path) -> dict:
    page = path.read_text(encoding="utf-8")
    heads = [re.sub(r"<[^>]*>|\s+", " ", x).strip() for x in re.findall(r"(?is)<h2\b[^>]*>(.*?)</h2>", page)]
    _expect(any(re.search("SUMARIO", h, re.I) for h in heads), "no block SUMARIO", headings=heads[:10])
    ministries = len(re.findall(r"(?i)<h3\b", page))
    _expect(ministries > 0, "SUMARIO without ministries")
    return {"ministries": ministries}


CHECKS = {"igae_mensual": _execution, "placsp": _contracts, "bdns": _grants, "boe_sumario": _gazette, "consejo_ministros": _cabinet}


def diagnose(source: str, path: str) -> Diagnosis:
    """Diagnosis of a file of the source; of a source without check it is valid."""
    if source not in CHECKS:
        return Diagnosis(source, True, f"no check for {source}")
    try:
        return Diagnosis(source, True, "", CHECKS[source](Path(path)))
    except _Unexpected as e:
        return Diagnosis(source, False, str(e), e.details)
    except Exception as e:  # whatever a foreign file brings about is what there is to say of it
        return Diagnosis(source, False, f"cannot be read: {type(e).__name__}: {e}")
