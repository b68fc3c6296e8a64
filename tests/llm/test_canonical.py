from __future__ import annotations

import random

import pytest

from fiscalspark.llm import canonical, names

ENTRIES = [(0, 1, "Ministerio de Puertos y Faros", "MPF"), (0, 2, "Ministerio de Bosques y Montes", "MBM"), (7, 3, "Dirección General de Museos y Fomento", None), (7, 4, "Dirección General de Muestreos y Fomento", None), (7, 5, "Subsecretaría", "SUB"), (8, 6, "Subsecretaría", None)]
REFS = "grp long, ref long, name string, short string, remark array<string>"


def refs(spark):
    return spark.createDataFrame([(g, r, n, s, ["Ministerio de Puertos y Faros", "MPF"]) for g, r, n, s in ENTRIES], REFS)


def found(spark, values, **k):
    df = spark.createDataFrame(values, "grp long, value string")
    return {(r.grp, r.value): r.ref for r in canonical.map_values(df, refs(spark), **k).collect()}


@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("MINISTERIO DE PUERTOS Y FAROS", 1), ("Puertos y Faros, Ministerio de", 1), ("Mº Puertos/Faros", 1), ("M.P.F.", 1), ("Minsterio de Puretos y Faros - Estado", 1), ("MÂº de Puertos y Faros", 1), ("Ministerio Bosques & Montes (órgano gestor)", 2),
        ("Minis terio de Bos ques y Montes", 2), ("Consorcio Luna Creciente", 0), ("?", 0), ("", 0), ("   ", 0), ("x" * 20000, 0), ("00000", 0),
    ],
)
def test_top_level(spark, value, ref):
    assert found(spark, [(0, value)]) == {(0, value): ref}


def test_below_an_entry(spark):
    got = found(spark, [(7, "D.G. Museos y Fomento"), (7, "Dirección General de Muestreos Fomento"), (7, "DirecciÃ³n General de Museos y Fom"), (7, "Subsecretaría, Ministerio de Puertos y F"), (8, "Subsecretaria"), (9, "Subsecretaría")])
    assert list(got.values()).count(0) == 1 and got[9, "Subsecretaría"] == 0
    assert (got[7, "D.G. Museos y Fomento"], got[7, "Dirección General de Muestreos Fomento"], got[7, "DirecciÃ³n General de Museos y Fom"], got[7, "Subsecretaría, Ministerio de Puertos y F"], got[8, "Subsecretaria"]) == (3, 4, 3, 5, 6)


def test_shards_merge_and_nulls_repeats_empties(spark):
    values = [(0, "Ministerio de Puertos y Faro"), (0, "Ministerio de Puertos y Faro"), (0, None), (None, "x"), (0, "Bosques Montes, Ministerio")]
    want = {(0, "Ministerio de Puertos y Faro"): 1, (0, "Bosques Montes, Ministerio"): 2}
    assert found(spark, values) == want == found(spark, values, shard_rows=1)
    assert found(spark, []) == {}
    empty = canonical.map_values(spark.createDataFrame([(0, "a")], "grp long, value string"), refs(spark).limit(0))
    assert [r.ref for r in empty.collect()] == [0]


def test_tie_gives_none(spark):
    two = spark.createDataFrame([(0, 1, "Casa Aba", None, None), (0, 2, "Casa Aca", None, None)], REFS)
    df = spark.createDataFrame([(0, "Casa Ada")], "grp long, value string")
    assert [r.ref for r in canonical.map_values(df, two).collect()] == [0]


def brute_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_and_tree_against_brute_force():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9))) for _ in range(150)]
    for a in words[:40]:
        for b in words[:40]:
            assert names.close(a, b) == brute_levenshtein(a, b)
    tree = canonical.Tree((w, i) for i, w in enumerate(words))
    for q in words[:30]:
        for radius in (0, 1, 3):
            got = {(d, w) for d, w, _ in tree.within(q, radius)}
            assert got == {(d, w) for w in words if (d := brute_levenshtein(q, w)) <= radius}
    assert names.slips("abcd", "abdc") == 1 and names.close("abcd", "abdc") == 2


def test_four_swaps_in_a_long_name(spark):
    assert found(spark, [(7, "Direccion Geenral de Musoes y Fometno"), (7, "Driección Geenral de Musoes y Fometno"), (7, "Driección Geenral de Musoes y Fometo")]) == {(7, "Direccion Geenral de Musoes y Fometno"): 3, (7, "Driección Geenral de Musoes y Fometno"): 3, (7, "Driección Geenral de Musoes y Fometo"): 3}


@pytest.mark.parametrize("shard_rows", [1, 7, 20_000])
def test_same_for_any_number_of_shards(spark, shard_rows):
    # a word of another entry bars an answer, whichever shard holds it; a name goes before a cut one; a short form is the entry's own
    rows = [(0, 1, "Consejo de Montes", None, None), (0, 2, "Patronato de Montas", None, None), (0, 3, "Dirección General de Museos y Fomento", "DGM", None), (0, 4, "Dirección General de Museos y Fomento del Litoral", None, None), (0, 5, "Gerencia de Presupuestos y Cuentas", None, None)]
    rows += [(0, 10 + i, f"Oficina {w} de Riegos", None, None) for i, w in enumerate(("primera", "segunda", "tercera", "cuarta", "quinta"))]
    want = {"Consejo de Montas": 0, "Consejo de Montos": 1, "DGM": 3, "Dirección General de Museos y Fometno": 3, "Dirección General de Museos y Fomento del Litora": 4, "Ofic. terecra de Riegos": 12, "Gerencia de Ppptos./Cuentas": 5, "Grnc. de Presupuestos y Cuentas": 5}
    df = spark.createDataFrame([(0, v) for v in want], "grp long, value string")
    assert {r.value: r.ref for r in canonical.map_values(df, spark.createDataFrame(rows, REFS), shard_rows=shard_rows).collect()} == want


def test_name_cut_early(spark):
    long = spark.createDataFrame([(0, 1, "Subsecretaría de Conservación de Acequias, Presas y Canales del Interior", None, None)], REFS)
    df = spark.createDataFrame([(0, "Subsecretaría de Conserva")], "grp long, value string")
    assert [r.ref for r in canonical.map_values(df, long).collect()] == [1]


def test_values_are_searched_by_several_tasks(spark):
    values = spark.range(400).selectExpr("0L AS grp", "concat('Minsterio ', id) AS value").distinct()
    tasks = canonical.spread_by(values, "grp", "value").mapInPandas(lambda fs: (f.head(0).assign(n=0) if f.empty else f.head(1).assign(n=len(f)) for f in fs), "grp long, value string, n long")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and tasks.count() >= 4
