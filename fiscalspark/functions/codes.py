"""Column functions for the codes of the domain (units, sections, services, periods, hashes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dir3(c: Column | str) -> Column:
    """Unit code in clean capitals; blank gives null."""
    return F.nullif(F.upper(F.trim(_col(c))), F.lit(""))


def two_digits(c: Column | str) -> Column:
    """Section or service code as a number; null if it is not one."""
    return F.trim(_col(c)).try_cast("int")


def budget_key(year: Column | str, section: Column | str, service: Column | str) -> Column:
    """(year, section, service) as one long that sorts like the triple; -1 if a part is no number or out of range."""
    y, a, b = _col(year), two_digits(section), two_digits(service)
    ok = y.between(0, 99999) & a.between(0, 99) & b.between(0, 99)
    return F.when(ok, (y.cast("long") * 100 + a) * 100 + b).otherwise(F.lit(-1).cast("long"))


def period(c: Column | str) -> Column:
    """YYYY-MM from 2024-03, 2024-3, 2024/03, 202403 or 03/2024 with outer blanks; anything else trimmed as it is."""
    t = F.trim(_col(c))
    first = F.regexp_extract(t, r"^(\d{4})\D?(\d{1,2})$", 0)
    year, month = F.regexp_extract(t, r"^(\d{4})\D?(\d{1,2})$", 1), F.regexp_extract(t, r"^(\d{4})\D?(\d{1,2})$", 2)
    last_year, last_month = F.regexp_extract(t, r"^(\d{1,2})\D(\d{4})$", 2), F.regexp_extract(t, r"^(\d{1,2})\D(\d{4})$", 1)
    return (
        F.when(first != "", F.concat(year, F.lit("-"), F.lpad(month, 2, "0")))
        .when(last_year != "", F.concat(last_year, F.lit("-"), F.lpad(last_month, 2, "0")))
        .otherwise(t)
    )


def hash16(c: Column | str) -> Column:
    """16-digit hexadecimal value in small letters without blanks, 0x or sha256: before it; null if it is none."""
    t = F.regexp_replace(F.lower(F.trim(_col(c))), r"^(sha-?256:|0x)\s*", "")
    return F.when(t.rlike(r"^[0-9a-f]{16}$"), t)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
