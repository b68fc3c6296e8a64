"""Reading of names of public bodies as people type them."""

from __future__ import annotations

import re
import unicodedata

#: Short forms of words in names of bodies, as they are written in official lists.
SHORT = {
    "mº": "ministerio", "min": "ministerio", "minist": "ministerio", "dg": "direccion general", "dir": "direccion", "direcc": "direccion",
    "gral": "general", "sec": "secretaria", "secret": "secretaria", "sria": "secretaria", "sg": "secretaria general", "sdg": "subdireccion general", "subdir": "subdireccion",
    "inst": "instituto", "patr": "patronato", "ger": "gerencia", "ag": "agencia", "interv": "intervencion", "conc": "concejalia",
    "concej": "concejalia", "pptos": "presupuestos", "subsec": "subsecretaria", "ayto": "ayuntamiento", "dip": "diputacion", "gab": "gabinete",
    "tec": "tecnica", "deleg": "delegacion", "insp": "inspeccion", "inspecc": "inspeccion", "ofic": "oficina", "of": "oficina", "serv": "servicio",
    "comis": "comisaria", "ctro": "centro", "cons": "consejo", "cent": "centro", "mancom": "mancomunidad", "univ": "universidad",
}
#: Words that join others and that people leave out or exchange.
JOINING = {"de", "del", "d", "la", "las", "el", "los", "y", "e", "i"}
#: Titles before the name of a town's council.
HONORIFICS = ("excmo", "exmo", "ilmo")
#: Remarks that people put behind a name.
REMARKS = ("organo gestor", "servicios centrales", "estado", "autonomica", "local", "otros", "capital")

_GARBLED = re.compile(r"[ÃÂãâ][\x80-\xbf‘-„Œ-žˆ˜†-•…‰‹›€™]")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte code, also after a change of case."""

    def one(m: re.Match) -> str:
        pair = m.group().replace("ã", "Ã").replace("â", "Â")
        for code in ("latin-1", "cp1252"):
            try:
                return pair.encode(code).decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
        return m.group()

    return _GARBLED.sub(one, text)


def plain(text: str) -> str:
    """Repaired, small letters, no accents, single blanks."""
    t = unicodedata.normalize("NFD", repair(text).replace("º", "º").lower())
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"\s+", " ", t).strip()


def words(text: str, expand: bool = True) -> list[str]:
    """Words of a plain text without those that only join, short forms written out."""
    if expand:
        text = re.sub(r"\b([a-z])\.\s?([a-z])\.", r"\1\2 ", text)
    out: list[str] = []
    for w in re.findall(r"[a-z0-9ºç]+", text):
        if expand and w in SHORT:
            out += SHORT[w].split()
        elif w not in JOINING and not (w[0] == "d" and 2 <= len(w) <= 4 and w[-1] in "el" and slips(w, "del") <= 1):
            out.append(w)
    return out


def squeeze(text: str, expand: bool = True) -> str:
    """The words of a plain text run together: blanks at wrong places make no difference."""
    return "".join(words(text, expand))


def close(a: str, b: str) -> int:
    """Levenshtein distance (a true metric), bit-parallel over the characters of a."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return score


def slips(a: str, b: str) -> int:
    """Typing slips from a to b: letters put in, left out, exchanged or swapped with the next."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


def shortens(w: str, full: str) -> bool:
    """Whether w can be a short form of full: its letters, those written twice once, stand in full in their order, the first in front."""
    if len(w) < 2 or w[:1] != full[:1] or len(full) < len(w) + 2:
        return False
    rest = iter(full)
    return all(c in rest for c, before in zip(w, " " + w) if c != before)


def front(text: str) -> str:
    """text with a dotted short form at its front written out, also one with a slip in it, where only one word is meant."""
    m = re.match(r"^([a-z]{2,7})\.\s*(.*)$", text)
    if not m or m.group(1) in SHORT:
        return text
    w, rest = m.groups()
    full = sorted(set(SHORT.values()))
    for meant in ([v for k, v in SHORT.items() if len(k) > 2 and slips(w, k) <= 1], [v.split()[0] for v in full if len(w) > 2 and v.startswith(w)], [v.split()[0] for v in full if len(w) > 2 and v[0] == w[0] and slips(w, v[: len(w)]) <= 1], [v.split()[0] for v in full if shortens(w, v.split()[0])]):
        if meant:
            return f"{meant[0]} {rest}" if len(set(meant)) == 1 else text
    return text


def is_remark(part: str, remarks: tuple[str, ...]) -> bool:
    """Whether part is one of the remarks, perhaps cut short or with slips."""
    p = squeeze(part, False)
    if not p:
        return True
    for r in remarks:
        q = squeeze(plain(r), False)
        if q.startswith(p) or (len(p) > 4 and slips(p, q[: len(p)]) <= 1) or (len(q) > 4 and slips(p, q) <= 2):
            return True
    return False


def readings(value: str, remarks: tuple[str, ...] = ()) -> list[str]:
    """Plain texts that value may stand for: without remarks behind it, and turned round at a comma."""
    known = REMARKS + remarks
    out = [plain(value)]
    t = out[0].strip(" .-")
    for _ in range(2):
        m = re.match(r"^(.+?)(?:\s*\(([^()]*)\)?|\s+-\s*([^-]*)|,\s*([^,]*))$", t)
        tails = [x for x in re.finditer(r"\s*\(|\s-(?:\s|$)|,", t)]
        if not m or not tails:
            break
        at = tails[-1]
        if is_remark(t[at.end() :].strip(" )."), known):
            t = t[: at.start()].strip(" .-")
            out.append(t)
        else:
            break
    for u in list(out):
        if "," in u:
            head, tail = u.rsplit(",", 1)
            out.append(f"{tail.strip()} {head.strip()}")
    return list(dict.fromkeys(x for x in out if x))
