from __future__ import annotations

import random

import pytest

from fiscalspark import session


def brute(big, small, how):
    out = []
    for k, x in big:
        hits = [y for j, y in small if k is not None and j == k]
        if how == "inner":
            out += [(k, x, y) for y in hits]
        elif how == "left":
            out += [(k, x, y) for y in hits] or [(k, x, None)]
        elif (how == "left_semi") == bool(hits):
            out.append((k, x))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_with_a_hot_key_against_brute_force(spark, monkeypatch, how):
    rnd = random.Random(3)
    big = [("h" if rnd.random() < 0.4 else rnd.choice("abcdefgz"), i) for i in range(400)] + [(None, i) for i in range(60)] + [("h", 7), ("h", 7)]
    small = [(k, j) for k in "habcdef" for j in range(2)] + [(None, 5)]
    b, s = spark.createDataFrame(big, "k string, x int"), spark.createDataFrame(small, "k string, y int")
    split = []
    monkeypatch.setattr(session, "max", lambda a, least: a, raising=False)  # hot from a share of the rows on, however few there are
    found = session.hot_keys(b, ["k"], 4)
    split += [r.k for r in found.collect()]
    assert split == ["h"]
    for rows in (1, 100):
        got = [tuple(r) for r in session.salted_join(b, s, ["k"], how, broadcast_rows=rows).collect()]
        assert sorted(got, key=repr) == brute(big, small, how)
    got = [tuple(r) for r in session.salted_join(b, s, ["k"], how, broadcast_rows=1, split=False).collect()]
    assert sorted(got, key=repr) == brute(big, small, how)


def test_bounds_are_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 50, "t string")
    assert session.fits(df) and not session.fits(df, rows=49) and not session.fits(df, size=10_000) and session.fits(df.limit(0))
    assert session.hot_keys(df, ["t"], 4) is None
