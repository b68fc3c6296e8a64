from __future__ import annotations

import datetime as dt
import random

import pytest

from fiscalspark.operators.asof import as_known

D0 = dt.date(2023, 12, 1)
EVENTS, VERSIONS = "id string, unit string, day date, vid string", "unit string, ini date, fin date, cap date, vid long, day date"


def day(n):
    return D0 + dt.timedelta(days=n)


def brute(events, versions):
    out = set()
    for i, u, d, *_ in events:
        if None in (i, u, d):
            continue
        latest = {}
        for vu, ini, fin, cap, vid, *_ in versions:
            if vu == u and ini is not None and cap is not None and cap <= d and (ini not in latest or (cap, vid) > latest[ini][:2]):
                latest[ini] = (cap, vid, fin)
        good = [(ini, v[1]) for ini, v in latest.items() if ini <= d and (v[2] is None or v[2] >= d)]
        if good:
            out.add((i, max(good)[1]))
    return out


@pytest.mark.parametrize("period", ["month", "quarter", "year"])
def test_equals_brute_force(spark, period):
    rnd = random.Random(period)
    versions = []
    for n in range(150):
        ini = day(rnd.randrange(300))
        versions.append((rnd.choice("abc") if n % 3 else "a", ini, rnd.choice([None, ini + dt.timedelta(days=rnd.randrange(-5, 90))]), ini + dt.timedelta(days=rnd.randrange(-20, 120)), n, D0))
    versions += versions[:20] + [(None, day(0), None, day(0), 900, D0), ("a", None, None, day(0), 901, D0), ("a", day(0), None, None, 902, D0)]
    events = [(str(i), "a" if i % 2 else rnd.choice("abcd"), day(rnd.randrange(420)), "clash") for i in range(200)]
    events += events[:10] + [(None, "a", day(9), ""), ("n1", None, day(9), ""), ("n2", "a", None, "")]
    got = as_known(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), period).collect()
    assert len(got) == len(set(got))
    assert {(r.id, r.vid) for r in got} == brute(events, versions)


def test_later_knowledge_is_not_used(spark):
    versions = [("a", day(0), None, day(40), 1, D0), ("a", day(0), day(20), day(60), 2, D0)]
    events = [("before", "a", day(30), ""), ("open", "a", day(50), ""), ("closed", "a", day(70), "")]
    got = as_known(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)).collect()
    assert {(r.id, r.vid) for r in got} == {("open", 1)}


def test_empty_tables(spark):
    e, v = spark.createDataFrame([], EVENTS), spark.createDataFrame([], VERSIONS)
    assert as_known(e, v).collect() == []
    assert as_known(spark.createDataFrame([("1", "a", D0, "")], EVENTS), v).collect() == []
