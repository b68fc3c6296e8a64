from __future__ import annotations

import random

import pytest

from fiscalspark.llm import truncation

NOUNS = "plazas montes diques costas norias vados silos redes faros muelles pinares vegas".split()
SENTENCES = [
    "El centro directivo propone revisar las tarifas de {0} a partir de enero de 2025.",
    "La convocatoria tiene por objeto financiar proyectos de {0} en los municipios colindantes.",
    "Se publica la relación de concesiones de {0} para general conocimiento.",
    "El crédito del programa {1} asciende a {2} euros y se destina a {0}.",
]
ENDS = ["", "\nEl Subsecretario", "\nImporte total: {2} €", "\nRef. SUB-{3}/2024", "\nAnexo: cuadro de {0}", " Contacto: oficina de {0}, de 9 a 14 h"]


def corpus(n=600, seed=1):
    """Texts with the ids of those that were cut inside a word or sentence, and of those where that cannot be told."""
    rnd = random.Random(seed)
    fill = lambda t: t.format(rnd.choice(NOUNS), f"{rnd.randrange(100, 999)}A", f"{rnd.randrange(1, 999)}.{rnd.randrange(100, 999)},50", rnd.randrange(10000, 99999))
    rows, cut, open_ = [], set(), set()
    for i in range(n):
        full = " ".join(fill(rnd.choice(SENTENCES)) for _ in range(rnd.randrange(1, 7))) + fill(rnd.choice(ENDS))
        source = rnd.choice(["a", "b"])
        at = 300 if source == "a" else rnd.randrange(30, len(full)) if rnd.random() < 0.05 else len(full)
        text = full[:at]
        if text != full:
            left, rest = text.rstrip(), full[len(text.rstrip()) :]
            (open_ if left.endswith(".") or rest[:1] in ".\n" else cut).add(i)
        rows.append((i, text, source))
    return rows, cut, open_


SCHEMA = "doc_id long, text string, source string"


def test_cut_texts_and_limits(spark):
    rows, cut, open_ = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    limits = {(r.source, r.unit, r.len) for r in truncation.length_limits(truncation.endings(docs)).collect()}
    assert ("a", "chars", 300) in limits and not any(s == "b" and n > 100 for s, _, n in limits)
    got = {r.doc_id for r in truncation.truncated(docs).collect()} - open_
    hit = len(got & cut)
    assert hit >= 0.9 * len(cut) and hit >= 0.9 * len(got)
    rates = {r.source: r for r in truncation.truncation_rates(docs).collect()}
    assert rates["a"].cut > rates["b"].cut and rates["a"].at_limit > 0.5 * rates["a"].cut and rates["a"].n + rates["b"].n == len(rows)


def test_nulls_blanks_repeats_and_very_long_texts(spark):
    rows, _, _ = corpus(200, 2)
    odd = [(1000, None, "a"), (1001, "", "a"), (1002, "  \n", "b"), (1003, "palabra " * 20000, "b"), (1004, rows[0][1], None), (1005, "…", "a"), (1006, "<p></p>", "a"), (None, "texto", "a")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows + odd + rows[:5]], SCHEMA + ", cut string")
    got = [r.doc_id for r in truncation.truncated(docs).collect()]
    assert not {1000, 1001, 1002, 1005, 1006} & set(got)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert truncation.truncated(docs).collect() == [] and truncation.truncation_rates(docs).collect() == []


@pytest.mark.parametrize(
    ("text", "stopped", "marked", "remnant", "last"),
    [("Acaba bien. →", True, False, False, "bien"), ("El seguimiento de los indicador…", False, True, False, "indicador"), ("acordó tras el tem-", False, False, True, "tem"), ("Podrán s<b", False, False, True, "s"), ("<p>Uno.</p>\n<p>Dos.</p>", True, False, False, "dos"), ("general co [...]", False, True, False, "co"), ("Total 5,00 €", False, False, False, "€")],
)
def test_ending(text, stopped, marked, remnant, last):
    e = truncation.Ending(text)
    assert (e.stopped, e.marked, e.remnant, e.tokens[-1]) == (stopped, marked, remnant, last)


def test_poisson_tail():
    import math

    for n, m in ((1, 0.5), (3, 0.01), (7, 3.0), (60, 40.0)):
        exact = 1 - sum(math.exp(-m) * m**k / math.factorial(k) for k in range(n))
        assert truncation.poisson_tail(n, m) == pytest.approx(exact, rel=1e-6)


def test_hazards_are_tested_against_the_exposure_of_the_neighbours(spark):
    # 'steep': hardly any text goes on beyond 100, where 9 of the last 11 end; 'short': lengths below 1 are none; 'one': no neighbour
    lengths = {"steep": [*[x for x in range(80, 100) for _ in range(20)], *[100] * 9, 110, 115], "short": [1] * 40 + [2] * 4 + [3] * 5 + list(range(4, 40)), "one": [1] * 9}
    ends = spark.createDataFrame([(s, n, n) for s, all_ in lengths.items() for n in all_], "source string, chars int, bytes int")
    got = {(r.source, r.unit, r.len): r.expected for r in truncation.length_limits(ends, fdr=2.0).collect()}
    want = {}
    for s, all_ in lengths.items():
        for x in set(all_):
            window = [y for y in range(max(1, x - 20), x + 21) if y != x]
            nearby, exposed = sum(all_.count(y) for y in window), sum(sum(z >= y for z in all_) for y in window)
            mean = sum(z >= x for z in all_) * (nearby + 0.5) / exposed if exposed else None
            if mean is not None and all_.count(x) > 2 and all_.count(x) > mean:
                want |= {(s, unit, x): pytest.approx(mean) for unit in ("chars", "bytes")}
    assert got == want and ("one", "chars", 1) not in got and ("steep", "chars", 100) in got


def test_many_texts_cut_at_the_same_place_are_no_ending(spark):
    rows, _, _ = corpus(600, 3)
    # each stub ends eight different texts: cut in the first word, in a later one, behind a word, and in a last line that only ends texts
    stubs = [" La convoc", " La convocatoria tiene por obj", " La convocatoria", " El crédito del progr", "\nEl Subsec", "\nRef. SUB-1"]
    full = [" La convocatoria tiene por objeto financiar proyectos de redes en los municipios colindantes.", "\nEl Subsecretario", "\nRef. SUB-12345/2024"]
    rows = [(i, t, s) for i, t, s in rows if s == "b"]
    texts = lambda ends, n, at: {at + 1000 * k + i: f"Se publica la relación {chr(97 + i // 20)}{chr(97 + i % 20)} para general conocimiento." + end for k, end in enumerate(ends) for i in range(n)}
    cut, whole = texts(stubs, 8, 10_000), texts(full, 200, 20_000)
    docs = spark.createDataFrame(rows + [(i, t, "c") for i, t in (cut | whole).items()], SCHEMA)
    got = {r.doc_id for r in truncation.truncated(docs).collect()}
    assert set(cut) <= got and not set(whole) & got


def test_copies_of_the_corpus_change_nothing(spark):
    # a divided word at the end of a line, and a title that no other text has, once in the corpus and once in each copy
    odd = [(8000, "Se publica la relación.\nLa convo\ncatoria tiene por objeto las redes.", "b"), (8001, "El crédito asciende a mucho. La convo", "b"), (8002, "Índice de norias, vados y silos", "b"), (8003, "En norias, vados y silos que no constan se actuará.", "b")]
    rows = corpus(300, 4)[0] + odd
    of = lambda docs: {(r.doc_id, r.limite, r.rotura) for r in truncation.judged(spark.createDataFrame(docs, SCHEMA)).collect()}
    once = of(rows)
    assert of([(i + 100_000 * k, t, s) for k in range(8) for i, t, s in rows]) == {(i + 100_000 * k, a, b) for k in range(8) for i, a, b in once}


def test_words_that_begin_as_the_last_one(spark):
    texts = ["la comisión de valoración. La comida de hoy\nla com", "la comisión, y la com. fin", "ya la com"]
    c = truncation.Contexts([truncation.tokens(t) for t in texts], {})
    key, goes_on, stop, _ = c.counted()
    at = [i for i, w in enumerate(c.words) if w == "com"]
    found = {int(k): (int(a), int(b)) for k, a, b in zip(key, goes_on, stop)}
    # behind 'la' where a line or sentence begins: comisión twice, comida once; the other two stand behind other words
    assert [found.get(int(c.px[i : i + 1].view("int64")[0])) for i in at] == [(3, 0), (0, 1), None]


def test_letters_of_a_very_long_word():
    c = truncation.Contexts([["a" * 200_000, "b"]], {})
    assert len(c.letters("px")[0]) == 200_000
