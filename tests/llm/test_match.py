from __future__ import annotations

import random

from fiscalspark.llm import match

UNITS = [
    ("E1", "Gerencia de Mesetas de Cauces y Corrales de Plazas", "Ministerio de Puertos y Faros", "Zarchullo"),
    ("E1", "Oficina de Fuentes de Plazas y Vados de Jardines", "Ministerio de Puertos y Faros", "Zarchullo"),
    ("E2", "Centro de Montes de Diques y Planos de Patrones", "Ministerio de Bosques y Montes", None),
    ("E3", "Centro de Reses de Laderas", "Ministerio de Bosques y Montes", "Galcesa"),
    ("E4", "Centro de Reses de Laderas", "Ministerio de Puertos y Faros", "Galcesa"),
    ("E5", "Agencia de Boyas de Encinares y Telares de Costas en Navadaña", "Ministerio de Puertos y Faros", "Navadaña"),
    (None, "Nada", None, None),
    ("E6", None, None, None),
]
ROWS = "id long, a string, b string, section string, town string, u string"


def result(spark, rows):
    units = spark.createDataFrame(UNITS, "u string, name string, section string, town string")
    return match.cascade(spark.createDataFrame([(*r, "clash") for r in rows], ROWS), units)


def test_rules_in_order(spark):
    rows = [
        (1, "GERENCIA DE MESETAS DE CAUCES Y CORRALES DE PLAZAS", None, "Mº Puertos y Faros", "zarchullo (capital)"),
        (2, "Oficina Fuentes Plazas Vados Jardines", None, None, "Zarchullo"),
        (3, "Gerencia de Mesetas de Cauces", None, "Ministerio de Puertos y Faros", "Zarchullo"),
        (4, "Centro de Motnes de Diques y Pla nos de Patrones", None, "Ministerio de Bosques y Montes", "Otrositio"),
        (5, "Centro de Reses de Laderas", None, None, "Galcesa"),
        (6, "Centro de Reses de Laderas", None, "Minsterio de Bosques y Montes", "Galcesa"),
        (7, None, "Ag. de Boyas de Encinares y Telares de Costas", "Ministerio de Puertos y Faros", None),
        (8, "Patronato de Cosas", None, "Ministerio de Puertos y Faros", "Zarchullo"),
        (9, None, None, None, None),
        (10, "", " ", "", ""),
        (11, "Gerencia de Mesetas de Cauces", None, "Ministerio de Bosques y Montes", "Galcesa"),
        (12, "palabra " * 3000, None, None, None),
    ]
    got = {r.id: (r.u, r.rule) for r in result(spark, rows + rows[:3]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "E1", 2: "E1", 3: "E1", 4: "E2", 6: "E3", 7: "E5"}
    assert got[1][1] == "nombre_entero_m_t" and got[3][1].startswith("nombre_cabeza") and got[4][1].startswith("palabras_entero")


def test_confidence_is_the_smoothed_precision(spark):
    found = spark.createDataFrame([(1, "E1", "r"), (2, "E2", "r"), (3, "E3", "s"), (4, "E4", "r"), (5, "E5", "q")], "id long, u string, rule string")
    labelled = spark.createDataFrame([(1, "E1"), (2, "E9"), (3, "E8")], "id long, known string")
    assert {r.rule: (r.n, r.right, r.confidence) for r in match.rule_precision(found, labelled).collect()} == {"r": (2, 1, 0.5), "s": (1, 0, 1 / 3)}
    assert {r.id: r.confidence for r in match.matched(found, labelled).collect()} == {4: 0.5, 5: 0.5}
    assert match.matched(found, labelled, least=0.6).collect() == []


def test_empty_tables(spark):
    assert result(spark, []).collect() == []
    none = spark.createDataFrame([], "u string, name string, section string, town string")
    assert match.cascade(spark.createDataFrame([(1, "x", None, "m", "t", "")], ROWS), none).collect() == []


def test_names_without_a_pair_or_triple_of_right_words(spark):
    ministry = "Ministerio de Puertos y Faros"
    many = "Mesa de " + " ".join(f"Nombre{x}" for x in "abcdefghijklmn")
    units = spark.createDataFrame([("E1", "Gerencia de Bancales de Salinas", ministry, None), ("E2", "Astilleros", ministry, None), ("E3", "Oficina de Telares de Encinares Lagunas y Norias", ministry, None), ("E4", many, ministry, None)], "u string, name string, section string, town string")
    rows = [(1, "Gerenacia de Bancles de Salinsa"), (2, "Astilelros"), (3, "Oficina de Telraes de Encinaers Lagnuas y Norias"), (4, many.replace("Nombreg", "Nomreg").replace("Mesa", "Msa")), (5, "Gerenacia de Bancles de Salimares")]
    got = {r.id: r.u for r in match.cascade(spark.createDataFrame([(*r, None, ministry, None, "clash") for r in rows], ROWS), units).collect()}
    assert got == {1: "E1", 2: "E2", 3: "E3", 4: "E4"}


def test_keys_meet_wherever_near_admits_the_name():
    rnd = random.Random(5)
    for _ in range(3000):
        w = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 8))) for _ in range(rnd.randrange(1, 7))]
        s, us = "".join(w), "".join(w)
        for _ in range(rnd.randrange(match.edits(len(us)) + 1)):
            k = rnd.randrange(len(s) + 1)
            s = s[:k] + rnd.choice(["", rnd.choice("abcde")]) + s[k + rnd.randrange(2) :]
        keys = set(match.unit_keys(us, w))
        assert keys & set(match.row_keys(s, []))
        known = [x for x in dict.fromkeys(w) if len(x) > 3]
        assert not known or keys & set(match.row_keys(s, rnd.sample(known, rnd.randrange(1, len(known) + 1))))


def test_town_behind_the_name(spark):
    units = spark.createDataFrame([("E1", "Centro de Reses de Laderas en Galcesa", "M", "Galcesa"), ("E2", "Centro de Reses de Laderas", "M", "Galcesa"), ("E3", "Oficina de Boyas de Fraguas en Corvilla", "M", None)], "u string, name string, section string, town string")
    rows = [(1, "Centro Reses Laderas Galcesa", None), (2, "Centro de Reses de Laderas", None), (3, "Oficina de Boyas de Fraguas", None), (4, "Oficina de Boyas de Fraguas en Cor villa", "Corvilla (capital)"), (5, "Oficina de Boyas de Fraugas Corvilla", "corvilla (capital)")]
    got = {r.id: (r.u, r.rule) for r in match.cascade(spark.createDataFrame([(i, a, None, "M", t, "clash") for i, a, t in rows], ROWS), units).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "E1", 2: "E2", 3: "E3", 4: "E3", 5: "E3"}
    assert got[3][1].startswith("nombre_corto") and got[5][1].startswith("palabras_entero")


def test_labelled_rows_judge_each_rule_with_what_it_joins(spark):
    units = spark.createDataFrame(UNITS, "u string, name string, section string, town string")
    rows = [(1, "Centro de Reses de Laderas", None, "Ministerio de Bosques y Montes", "Galcesa", ""), (2, "Centro de Montes de Diques y Planos de Patrones", None, "Ministerio de Bosques y Montes", None, ""), (3, "Centro de Motnes de Diques y Planos de Patrones", None, None, None, ""), (4, "Centro de Reses de Laderas", None, "Ministerio de Puertos y Faros", None, "")]
    labelled = spark.createDataFrame([(1, "E3"), (2, "E2"), (3, "E9")], "id long, known string")
    found = match.cascade(spark.createDataFrame(rows, ROWS), units, labelled)
    got = {(r.id, r.rule): r.u for r in found.collect()}
    # the name alone or with the town fits two units; a head is judged by names without what follows 'y'
    assert {k for k in got if k[0] == 1} == {(1, "nombre_entero_m_t"), (1, "nombre_entero_m")}
    assert {(2, "nombre_entero_m"), (2, "nombre_entero_solo"), (2, "nombre_cabeza_m"), (2, "nombre_cabeza_solo")} <= set(got)
    # a misspelt name judges only the rules that mend words, a right one only those that take it as it is
    assert {r for i, r in got if i == 3} == {"palabras_entero_solo", "nombre_cabeza_solo"} or {r for i, r in got if i == 3} == {"palabras_entero_solo", "palabras_cabeza_solo"}
    assert [r for i, r in got if i == 4] == ["nombre_entero_m"]
    rules = {r.rule: (r.n, r.right) for r in match.rule_precision(found, labelled).collect()}
    assert rules["nombre_entero_m"] == (2, 2) and rules["palabras_entero_solo"] == (1, 0)


def test_namesakes_do_not_multiply(spark):
    many = spark.range(3000).selectExpr("concat('E', id) AS u", "'Gabinete Tecnico' AS name", "concat('Ministerio ', id % 3) AS section", "CAST(NULL AS STRING) AS town")
    side = match.by_attributes(match.unit_names(many.withColumnsRenamed({"section": "m", "town": "t"})))
    assert side.count() == 4 * 2 and side.where("lo = hi").count() == 0
    rows = spark.createDataFrame([(i, "Gabinete Tecnico", None, "Ministerio 1", None, "") for i in range(5)], ROWS)
    assert match.cascade(rows, many).count() == 0
