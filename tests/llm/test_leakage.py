from __future__ import annotations

import random

from fiscalspark.llm import leakage

ITEM = (
    "Según el acta OBR-81159/2026, quien firmaba de la Delegación de Bodegas de Telares sostuvo que 21 de cada cien expedientes sobre plazas entraron sin sello a Palallado. "
    "De los 27 convenios firmados en Orbapecos por la Dirección General de Estuarios de Licencias, solo el SUB-12979/2023 toleraba pagos iguales a 2.503,29 euros para señales."
)
OTHER = "Según el acta EXP-11111/2024, quien firmaba de la Oficina de Vegas de Costas sostuvo que 77 de cada cien expedientes sobre dunas entraron sin sello a Gormontes. De los 5 convenios firmados en Salveles por la Agencia de Reses de Telares, solo el CON-22222/2022 toleraba pagos iguales a 900 euros para vados."
W = ITEM.split()


def part(lo, hi, change=()):
    w = W[lo:hi]
    for at, new in change:
        w[at] = new
    return "Texto previo. " + " ".join(x for x in w if x) + " y sigue el resto."


CASES = {
    1: (ITEM, True),
    2: (part(5, 26), True),
    3: (part(5, 26, [(4, "mismo"), (12, None)]), True),
    4: (part(5, 25, [(4, "mismo"), (9, "luego"), (14, "casi")]), False),
    5: (part(5, 15), False),
    6: ("<p>" + ITEM.upper().replace(" ", "  ").replace("SELLO", "SE-\nLLO") + "</p>", True),
    7: (part(0, 24).replace("expedientes", "expe dientes").replace("sobre plazas", "sobreplazas"), True),
    8: (OTHER, False),
    9: (ITEM.replace("OBR-81159/2026", "EXP-00001/2020").replace("Bodegas", "Norias").replace("21", "99").replace("Palallado", "Gormontes").replace("27", "4").replace("Orbapecos", "Salveles").replace("Estuarios", "Vados"), False),
    10: (None, False),
    11: ("", False),
    12: ("  \n ", False),
    13: ("relleno de texto sin más " * 4000 + part(5, 28), True),
    14: (part(5, 26, [(9, "21x1")]), True),
}


def test_cases(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, (t, _) in CASES.items()] + [(1, ITEM, "again")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, 1), (8, OTHER, 1), (9, None, 1), (10, "", 1), (11, "corto", 1)], "item_id long, text string, doc_id int")
    want = {(k, 7) for k, (_, leak) in CASES.items() if leak and k != 14} | {(8, 8)}
    got = [tuple(r) for r in leakage.leaks(docs, items).collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[0] != 14} == want
    assert {tuple(r) for r in leakage.leaks(docs, items, block=1).collect()} == set(got)
    assert leakage.leaks(docs.limit(0), items).collect() == [] and leakage.leaks(docs, items.limit(0)).collect() == []


def plain_window(item, text):
    """Brute force: least word edits of any 20 consecutive item words against any stretch of the text."""
    a, b = leakage.words_of(item)[0], leakage.words_of(text)[0]
    best = 99
    for s in range(len(a) - leakage.PASSAGE + 1):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a[s : s + leakage.PASSAGE], 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        best = min(best, min(row))
    return best


def test_against_brute_force_on_random_changes():
    rnd = random.Random(4)
    index = leakage.Items([(7, ITEM), (8, OTHER)])
    agree = 0
    for _ in range(150):
        lo = rnd.randrange(0, len(W) - 22)
        w = W[lo : lo + rnd.randrange(18, 34)]
        for _ in range(rnd.randrange(0, 5)):
            k = rnd.randrange(len(w))
            if any(c.isdigit() for c in w[k]):  # another figure is another item, which word edits do not know
                continue
            w[k : k + 1] = rnd.choice([[], ["luego"], [w[k], "casi"], [w[k][:-1] + "q"]])
        text = "El centro directivo propone revisar las tarifas. " + " ".join(w) + " Fin de la nota."
        agree += (7 in index.leaked(text)) == (plain_window(ITEM, text) <= leakage.EDITS)
    assert agree >= 147


def divided(at, w):
    return " ".join(x[:2] + " " + x[2:] if k in at else x for k, x in enumerate(w))


def test_passages_with_divided_words_in_every_run():
    index = leakage.Items([(7, ITEM), (8, OTHER)])
    w = W[3:25]
    assert index.leaked("Nota. " + divided({5, 10, 15}, w[:20]) + " fin.") == [7]
    assert index.leaked("Nota. " + divided({4}, [*w[:9], "luego", *w[10:14], "casi", *w[15:20]]) + " fin.") == [7]
    for every in (1, 2, 3, 4):  # no four words in a row are whole
        at = {k for k in range(len(w)) if k % every == 0 and len(leakage.words_of(w[k])[0][0]) > 3}
        assert index.leaked("Nota. " + divided(at, w) + " fin.") == [7], every
    together = [w[k] + (w[k + 1] if k + 1 < len(w) else "") for k in range(0, len(w), 2)]
    assert index.leaked("Nota. " + " ".join(together) + " fin.") == [7]
    assert index.leaked("Nota. " + divided({5, 10, 15}, [*w[:6], "luego", *w[7:12], "casi", *w[13:16], "mas", *w[17:20]]) + " fin.") == []


def test_figures_set_with_blanks():
    item = "El gasto de " + " ".join(f"{n}.{n + 400} euros para vados, {n + 17}.{n + 503} de senda {x}," for n, x in zip((21, 34, 57), ("uno", "dos", "tres")))
    index = leakage.Items([(7, item)])
    assert index.leaked(item.replace(".", " ")) == [7]
    assert index.leaked(item.replace(".4", ".9").replace(".", " ")) == []


def many_items():
    """27 items that share one passage, each with a passage of its own, and one that shares turns of phrase only."""
    words = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince".split()
    shared = " ".join(W[3:38])
    out = [(100 + i, f"Nota {words[i % 15]}{words[i // 15]} de la serie. {shared} Queda {words[i % 15]} en {words[(i + 3) % 15]} sobre {words[i // 15]}.") for i in range(27)]
    return [*out, (200, "Según el acta, quien firmaba de la Delegación de Bodegas de Telares dijo otra cosa sobre los plazos que nadie había visto en el archivo de la casa.")]


def test_passage_shared_by_many_items(spark):
    items = spark.createDataFrame([(i, t) for i, t in many_items()], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Nota previa. " + " ".join(W[8:30]) + " fin."), (2, "Nota. " + " ".join([*W[6:14], "luego", *W[15:22], "casi", *W[23:28]]) + " fin."), (3, "Nota. " + divided({3, 8, 13, 18}, W[5:27]) + " fin."), (4, " ".join(W[5:17]))], "doc_id long, text string")
    want = {(d, 100 + i) for d in (1, 2, 3) for i in range(27)}
    for block in (1, 7, 20_000):
        assert {tuple(r) for r in leakage.leaks(docs, items, block=block).collect()} == want, block


def test_names_are_those_of_the_whole_list(spark):
    a = "El plan fija que la casa de Zarala revise cada curso los libros que guarda el archivo del puerto y que nadie ha leído desde hace tiempo."
    b = "La nota dice que Vensoles pide más días para los trámites que la oficina abrió en marzo con la ayuda de los vecinos del barrio del norte."
    docs = spark.createDataFrame([(1, a), (2, a.replace("Zarala", "Vensoles")), (3, a.replace("Zarala", "Vensoles").lower()), (4, a.lower())], "doc_id long, text string")
    items = spark.createDataFrame([(1, a), (2, b)], "item_id long, text string")
    for block in (1, 20_000):
        assert {tuple(r) for r in leakage.leaks(docs, items, block=block).collect()} == {(1, 1), (4, 1)}, block
    assert leakage.names_of(items) == {"zarala", "vensoles"}


def all_windows(index, text):
    """Items by the exact check alone, on the whole text, without windows before it."""
    w, big = leakage.words_of(text)
    k = [leakage.kind(x, index.names) for x in w]
    return [i for i, own, kinds in zip(index.ids, index.words, index.kinds) if leakage.passage(own, kinds, w, k, big)]


def test_windows_lose_nothing_that_the_exact_check_accepts():
    rnd = random.Random(11)
    index = leakage.Items([(7, ITEM), (8, OTHER), *many_items()])
    for _ in range(120):
        i, t = rnd.choice([(7, ITEM), (8, OTHER), *many_items()])
        w = t.split()
        lo = rnd.randrange(0, max(1, len(w) - 21))
        w = w[lo : lo + rnd.randrange(19, 30)]
        for _ in range(rnd.randrange(0, 4)):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], ["luego"], [w[k], "casi"], [w[k][:2], w[k][2:]], [w[k] + "x"]])
        text = "Se abre la nota. " + " ".join(x for x in w if x) + " Se cierra."
        assert set(index.leaked(text)) >= set(all_windows(index, text)), text
