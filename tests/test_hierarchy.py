from __future__ import annotations

import random

import pytest

from fiscalspark.operators.hierarchy import descendants, hierarchy

SCHEMA = "code string, parent string, level int, ord long, root string"


def brute(rows):
    last = {}
    for c, p, lv, o, _ in rows:
        if c is not None and (c not in last or (o, p or "", lv or 0) > last[c][0]):
            last[c] = ((o, p or "", lv or 0), p)
    up = {c: (p if p in last and p != c else None) for c, (_, p) in last.items()}
    out = {}
    for c in up:
        path, x = [c], c
        while up[x] is not None and up[x] not in path:
            x = up[x]
            path.append(x)
        loop = 0 if up[x] is None else 1 if up[x] == c else 2
        below = set()
        todo = [c]
        while todo:
            y = todo.pop()
            for z, p in up.items():
                if p == y and z != c and z not in below:
                    below.add(z)
                    todo.append(z)
        out[c] = (path[-1] if not loop else "", len(path) if not loop else 0, "/".join(reversed(path)) if not loop else "", len(below), loop)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    rows = [(c, rnd.choice([None, c, "missing", *names, *names, *names[:5], *names[:5]]), rnd.randrange(5), rnd.randrange(3), "clash") for c in names for _ in range(rnd.choice([1, 1, 2]))]
    rows += rows[:9] + [(None, "n1", 1, 1, "")]
    got = hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len({r.code for r in got})
    assert {r.code: (r.root, r.depth, r.path, r.below, r.loop) for r in got} == brute(rows)


def test_only_a_loop_and_a_chain(spark):
    loop = [("a", "b", 1, 1, ""), ("b", "c", 1, 1, ""), ("c", "a", 1, 1, ""), ("d", "a", 1, 1, "")]
    got = {r.code: (r.loop, r.below) for r in hierarchy(spark.createDataFrame(loop, SCHEMA)).collect()}
    assert got == {"a": (1, 3), "b": (1, 3), "c": (1, 3), "d": (2, 0)}
    chain = [(str(i), str(i - 1) if i else None, None, 1, "") for i in range(9)]
    tree = hierarchy(spark.createDataFrame(chain, SCHEMA))
    assert {r.code: r.depth for r in tree.collect()} == {str(i): i + 1 for i in range(9)}
    assert descendants(tree).count() == 36


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], SCHEMA)).collect() == []


def test_descendants_on_and_below_loops(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("r", None), ("s", "r"), ("x", "y"), ("y", "x")]
    got = sorted(tuple(r) for r in descendants(hierarchy(spark.createDataFrame([(c, p, None, 1, "") for c, p in links], SCHEMA))).collect())
    loop = [("a", "c", 1), ("a", "b", 2), ("b", "a", 1), ("b", "c", 2), ("c", "b", 1), ("c", "a", 2), ("x", "y", 1), ("y", "x", 1)]
    assert got == sorted([*loop, ("a", "d", 1), ("b", "d", 2), ("c", "d", 3), ("d", "e", 1), ("a", "e", 2), ("b", "e", 3), ("c", "e", 4), ("r", "s", 1)])


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants_sum_to_below(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    up = {c: rnd.choice([None, *names, *names]) for c in names}
    up |= {f"k{i}": f"k{(i + 1) % 7}" for i in range(7)}
    tree = hierarchy(spark.createDataFrame([(c, p, None, 1, "") for c, p in up.items()], SCHEMA)).cache()
    want = set()
    for c in up:
        x, seen = c, [c]
        while up[x] not in (None, x) and up[x] not in seen:
            x = up[x]
            want.add((x, c, len(seen)))
            seen.append(x)
    rows = [tuple(r) for r in descendants(tree).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {r.code: r.below for r in tree.collect() if r.below} == {a: sum(x[0] == a for x in want) for a in {x[0] for x in want}}


def test_a_tree_higher_than_the_peeling(spark):
    """A long chain with leaves beside it, a loop with a long tail, against a walk along the links."""
    links = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(120)} | {f"l{i}": f"c{i * 7 % 120:03d}" for i in range(20)}
    links |= {"r0": "r2", "r1": "r0", "r2": "r1"} | {f"t{i:02d}": f"t{i - 1:02d}" if i else "r1" for i in range(60)}
    below = dict.fromkeys(links, 0)
    want = {}
    for x in links:
        way, seen, at = [x], {x}, links[x]
        while at is not None and at not in seen:
            way.append(at)
            seen.add(at)
            at = links[at]
        for a in way[1:]:
            below[a] += 1
        loop = 0 if at is None else 1 if at == x else 2
        want[x] = ("/".join(reversed(way)) if not loop else "", len(way) if not loop else 0, loop)
    rows = spark.createDataFrame([(k, p, 1, i) for i, (k, p) in enumerate(links.items())], "code string, parent string, level int, ord int")
    got = {r.code: r for r in hierarchy(rows).collect()}
    assert {k: (r.path, r.depth, r.loop) for k, r in got.items()} == want
    assert {k: r.below for k, r in got.items()} == below
