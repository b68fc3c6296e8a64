from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from fiscalspark.functions import codes
from fiscalspark.operators.snapshot_diff import snapshot_changes

SCHEMA = "grp string, num int, delivered timestamp, k string, v string, cambio string"
T0 = dt.datetime(2024, 1, 1)


def brute(rows):
    seen = defaultdict(lambda: defaultdict(list))
    for g, n, t, k, v, _ in rows:
        if g is not None and n is not None:
            seen[g, n][t].append((k, v))
    last = {gn: d[max(d)] for gn, d in seen.items()}
    out = set()
    for g in {g for g, _ in last}:
        nums = sorted(n for gg, n in last if gg == g)
        for a, b in zip(nums, nums[1:]):
            side = []
            for n in (a, b):
                d = {}
                for k, v in last[g, n]:
                    d[k] = max([x for x in (d.get(k), v) if x is not None], default=None)
                side.append(d)
            for k in side[0].keys() | side[1].keys():
                if k not in side[0]:
                    out.add((g, k, b, "alta"))
                elif k not in side[1]:
                    out.add((g, k, b, "baja"))
                elif None not in (side[0][k], side[1][k]) and side[0][k] != side[1][k]:
                    out.add((g, k, b, "cambio"))
    return out


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for g in ("a", "b"):
        for n in (1, 2, 4, 5, 9):
            for again in range(rnd.choice([1, 2])):
                t = T0 + dt.timedelta(hours=rnd.randrange(1000) * 2 + again)
                rows += [(g, n, t, rnd.choice(["x", "y", "z", "u", None, "w"]), rnd.choice(["1", "2", None]), "clash") for _ in range(6)]
    rows += rows[:15] + [(None, 1, T0, "x", "1", ""), ("a", None, T0, "x", "1", "")]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), ["k"], "v").collect()
    assert len(got) == len(set(got))
    assert {(r.grp, r.k, r.num, r.cambio) for r in got} == brute(rows)


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA), ["k"], "v").collect() == []


def test_spellings(spark):
    p = [" 2024-03", "2024/03", "202403", "03/2024", "2024-3", "2024-03", None, "?"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in p], "t string").select(codes.period("t").alias("p")).collect()]
    assert got == ["2024-03"] * 6 + [None, "?"]
    h = ["0xABCDEF0123456789", "SHA256:abcdef0123456789", " abcdef0123456789", "abc", None, "abcdef012345678g"]
    got = [r.h for r in spark.createDataFrame([(x,) for x in h], "t string").select(codes.hash16("t").alias("h")).collect()]
    assert got == ["abcdef0123456789"] * 3 + [None] * 3
