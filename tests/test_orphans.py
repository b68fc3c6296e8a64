from __future__ import annotations

import datetime as dt
import random

import pytest

from fiscalspark.functions import codes
from fiscalspark.operators import orphans

D0 = dt.date(2024, 1, 1)
REFS = "tabla string, clave string, periodo string, key long, c date, extra string"
PARENTS = "key long, desde date, hasta date, extra string"


def day(n):
    return D0 + dt.timedelta(days=n)


def brute(refs, parents):
    first = {}
    for t, k, p, key, c, *_ in refs:
        if k is None or key is None or c is None:
            continue
        if (t, k) not in first or (c, p, key) < first[t, k]:
            first[t, k] = (c, p, key)
    out = set()
    for (t, k), (c, p, key) in first.items():
        own = [(a, b) for kk, a, b, *_ in parents if kk == key and kk is not None and kk >= 0 and a is not None]
        if any(a <= c and (b is None or b > c) for a, b in own):
            continue
        out.add((t, k, p, "inexistente" if not own else "borrada" if any(a <= c for a, _ in own) else "tardia"))
    return out


@pytest.mark.parametrize(("per_range", "broadcast"), [(1000, 1000), (1000, 0), (7, 0), (1, 0)])
def test_equals_brute_force(spark, per_range, broadcast):
    rnd = random.Random(per_range)
    parents = [(rnd.randrange(30), day(rnd.randrange(50)), rnd.choice([None, day(rnd.randrange(20, 80))]), "x") for _ in range(60)] + [(None, day(1), None, "x"), (3, None, None, "x")]
    refs = [("t", str(rnd.randrange(200)), "2024-01", 5 if i % 3 == 0 else rnd.randrange(-1, 40), day(rnd.randrange(90)), "y") for i in range(400)]
    refs += refs[:50] + [("t", None, "p", 1, day(1), "y"), ("t", "n", "p", None, day(1), "y"), ("u", "1", None, 2, day(0), "y")]
    got = orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), per_range, broadcast).collect()
    assert len(got) == len({(r.tabla, r.clave) for r in got})
    assert {tuple(r) for r in got} == brute(refs, parents)


def test_empty_tables(spark):
    none_r, none_p = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    one = spark.createDataFrame([("t", "1", "p", 1, D0, "y")], REFS)
    assert orphans.orphan_references(none_r, none_p).collect() == []
    assert [r.motivo for r in orphans.orphan_references(one, none_p).collect()] == ["inexistente"]
    assert [r.motivo for r in orphans.orphan_references(one, none_p, 1, 0).collect()] == ["inexistente"]
    report = orphans.orphan_report(orphans.orphan_references(one, none_p)).collect()
    assert [(r.tabla, r.periodo, r.motivo, r.n) for r in report] == [("t", "p", "inexistente", 1)]


def test_budget_key_spellings(spark):
    rows = [(2024, "9", " 09 "), (2024, "09", "9"), (2024, "x", "1"), (None, "1", "1"), (2024, "1", "123")]
    keys = [r.k for r in spark.createDataFrame(rows, "y int, a string, b string").select(codes.budget_key("y", "a", "b").alias("k")).collect()]
    assert keys == [20240909, 20240909, -1, -1, -1]
