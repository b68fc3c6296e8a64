"""Matching entities across sources without keys: a cascade of exact joins on ever weaker attribute combinations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fiscalspark.llm import names
from fiscalspark.llm.canonical import map_values
from fiscalspark.session import materialise, salted_join, ship, spread, spread_by

#: How the name is compared: as it is, each of its words brought to the nearest word of any unit's name, or letter by letter.
KINDS = ("nombre", "palabras", "letras")
#: Parts of a unit's name that a reading may give: all of it, all but the town behind it, its head before ' y '.
PARTS = ("entero", "corto", "cabeza")
#: (rule, part of the name, how it is compared, joined attributes). Attributes that are not joined must not contradict.
RULES = [(f"{kind}_{part}_{'_'.join(by) or 'solo'}", part, kind, by) for kind in KINDS for part in PARTS for by in (("m", "t"), ("m",), ("t",), ())]
#: Values of a joined attribute in the table of units: any value at all, and none known.
ANY, NONE = "*", ""
#: Words of a unit's name beyond which it is found by single words instead of pairs, whose number would grow with the square.
MANY = 12
#: Most edits that near() admits.
MOST = 6


def said_words(text: str) -> list[str]:
    """Words of a plain name; 'en' before a town is left out by some."""
    return [w for w in names.words(text) if w != "en"]


def core(text: str | None, town: str | None = None, section: str | None = None) -> list[tuple[str, list[str], int]]:
    """(letters, words, rank) of each reading of a name, without remarks: rank 0 as it is, rank 1 without the town behind it."""
    out: dict[str, tuple[list[str], int]] = {}
    places = {names.squeeze(x, False) for x in names.readings(town)} if town else set()
    for t in names.readings(text or "", tuple(x for x in (town, section) if x)):
        t = names.front(re.sub(r"\s*[(,-]\s*(?:ministerio|minist|min|mº)\b.*$", "", t))
        whole = said_words(t)
        short = [said_words(m.group(1)) for m in [re.match(r"^(.{8,}) en [a-z ]+\.?$", t)] if m]
        short += [whole[:-k] for k in (1, 2) if len(whole) > 2 + k and any(len(p) > 4 and names.slips("".join(whole[-k:]), p) <= 2 for p in places)]
        for rank, w in ((0, whole), *((1, w) for w in short)):
            if w and rank <= out.get("".join(w), (w, 1))[1]:
                out["".join(w)] = (w, rank)
    return [(s, w, rank) for s, (w, rank) in out.items()]


def edits(n: int) -> int:
    """Edits that near() admits for a unit's name of n letters."""
    return 1 if n < 9 else 3 if n < 16 else 4 if n < 26 else 6


def segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of the edits(n) + 1 pieces of a name of n letters: so many edits leave one of them whole."""
    k = edits(n) + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def unit_keys(s: str, w: list[str]) -> list[str]:
    """Keys under which row_keys() looks for a unit's name: pairs of its words and single ones, and its pieces."""
    own = sorted({x for x in w if len(x) > 3})
    out = [f"g {len(s)} {i} {s[a : a + n]}" for i, (a, n) in enumerate(segments(len(s)))]
    if len(own) > MANY:
        return out + [f"l {x}" for x in own]
    return out + [f"s {x}" for x in own] + [f"p {x} {y}" for x, y in combinations(own, 2)]


def row_keys(s: str, known: list[str]) -> list[str]:
    """Keys that every unit's name has that cascade() can accept for letters s with these known words, rarest first.

    A name must hold all known words, so the two rarest (or the only one) bring up all there are. Without a known word the pieces
    do: an edit before a piece shifts it, so it stands in s where the shifts before and behind it come to at most edits(n).
    """
    if len(known) > 1:
        return [f"l {known[0]}", "p " + " ".join(sorted(known[:2]))]
    if known:
        return [f"l {known[0]}", f"s {known[0]}"]
    out = set()
    for n in range(max(1, len(s) - 6), len(s) + 7):
        k, more = edits(n), len(s) - n
        for i, (a, size) in enumerate(segments(n)):
            for at in range(max(0, a - k), min(len(s) - size, a + k) + 1):
                if abs(at - a) + abs(more - (at - a)) <= k:
                    out.add(f"g {n} {i} {s[at : at + size]}")
    return sorted(out)


VARIANT = "s string, words array<string>, part string"


def unit_names(units: DataFrame) -> DataFrame:
    """u, m, t and the PARTS of each name that a unit ever had."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for u, name, m, t in zip(f["u"], f["name"], f["m"], f["t"]):
                whole = names.plain(name)
                short = re.sub(r"^(.{8,}) en [a-z ]+$", r"\1", whole)
                for part, text in zip(PARTS, (whole, short if short != whole else "", short.split(" y ")[0] if " y " in short else "")):
                    w = said_words(text)
                    if w:
                        s = "".join(w)
                        out.append((u, m, t, s, w, part))
            yield pd.DataFrame(out, columns=["u", "m", "t", "s", "words", "part"])

    rows = units.where("u IS NOT NULL AND name IS NOT NULL").select("u", "name", F.col("m"), F.col("t")).distinct()
    return rows.mapInPandas(read, f"u string, m string, t string, {VARIANT}").distinct()


def row_names(rows: DataFrame) -> DataFrame:
    """sig, shown, rank and each reading of the names of a row; sig stands for all rows that say the same. shown is the part that
    the reading is for: null for all. A judged row shows each part its names as a row that gives only this part would: without
    the town, without what follows ' y '."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for sig, judged, a, b, town, section in zip(f["sig"], f["judged"], f["a"], f["b"], f["town"], f["section"]):
                seen: set[tuple] = set()
                for text in (a, b):
                    for s, w, rank in core(text, town, section):
                        seen.add((("corto" if rank else "entero") if judged else None, s, tuple(w), rank))
                    head, y, _ = names.plain(text or "").partition(" y ")
                    if judged and y:
                        seen.update(("cabeza", s, tuple(w), 0) for s, w, _ in core(head, town, section))
                out += [(sig, *x) for x in sorted(seen, key=repr)]
            yield pd.DataFrame(out, columns=["sig", "shown", "s", "words", "rank"])

    return rows.mapInPandas(read, "sig long, shown string, s string, words array<string>, rank int")


def by_attributes(unit: DataFrame) -> DataFrame:
    """part, us (letters), mk, tk and the first and last code (lo, hi) of the units of that name with these attributes, a value
    of m and t or ANY: a name belongs to one unit where lo is hi. A name of many units takes a row for each of their attributes,
    so joins with it do not grow with the units that share a name."""
    each = unit.select("part", F.col("s").alias("us"), F.explode(F.array(F.coalesce("m", F.lit(NONE)), F.lit(ANY))).alias("mk"), "t", "u")
    each = each.select("part", "us", "mk", F.explode(F.array(F.coalesce("t", F.lit(NONE)), F.lit(ANY))).alias("tk"), "u")
    return each.groupBy("part", "us", "mk", "tk").agg(F.min("u").alias("lo"), F.max("u").alias("hi"))


def resolved(readings: DataFrame, side: DataFrame, kind: str) -> DataFrame:
    """sig, judged, k and u by the rules of a kind. readings: sig, judged, shown, rm, rt, us and d (slips; the nearest name counts).

    A rule joins its attributes, which must be known and equal; those of the others that are known must be equal or unknown
    to the unit. So a reading asks for at most four rows of by_attributes(), each of which serves several rules. Of a judged row
    the attributes that a rule does not join are hidden. A rule takes a row only if one unit fits; of the rules an open
    row gets the first, a judged row all.
    """
    own = {x: F.col(f"r{x}") for x in ("m", "t")}
    values = {x: F.when(c.isNull(), F.array(F.lit(ANY))).when(F.col("judged"), F.array(c, F.lit(ANY))).otherwise(F.array(c, F.lit(NONE))) for x, c in own.items()}
    pairs = F.flatten(F.transform(values["m"], lambda m: F.transform(values["t"], lambda t: F.struct(m.alias("mk"), t.alias("tk")))))
    asked = readings.select("sig", "judged", "shown", "us", "d", "rm", "rt", F.explode(pairs).alias("x")).select("sig", "judged", "shown", "us", "d", "rm", "rt", "x.*")
    one = salted_join(asked, side, ["us", "mk", "tk"]).where("shown IS NULL OR shown = part")

    def serves(part: str, by: tuple[str, ...]) -> Column:
        fits = F.col("part") == part
        for x in ("m", "t"):
            if x in by:
                fits &= F.col(f"{x}k") == own[x]
            else:
                fits &= ~F.col("judged") | (F.col(f"{x}k") == ANY)
        return fits

    ks = F.array_compact(F.array(*[F.when(serves(part, by), F.lit(k)) for k, (_, part, how, by) in enumerate(RULES) if how == kind]))
    ruled = one.select("sig", "judged", "d", "lo", "hi", F.explode(ks).alias("k"))
    per = ruled.groupBy("sig", "judged", "k", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    nearest = per.groupBy("sig", "judged", "k").agg(F.min(F.struct("d", "lo", "hi")).alias("b")).where("b.lo = b.hi").select("sig", "judged", "k", F.col("b.lo").alias("u"))
    first = nearest.groupBy("sig", "judged").agg(F.min("k").alias("first"))
    return materialise(nearest.join(first, ["sig", "judged"]).where("judged OR k = first").drop("first"))


def repaired(readings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """s and fixed: letters of a reading with each word that no unit's name has brought to the nearest word that one has, by the
    tree of canonical.map_values(); only readings that change. readings: s, words; vocabulary: w."""
    words = materialise(readings.select("s", F.posexplode("words").alias("pos", "w")))
    unknown = words.where("length(w) > 4").select("w").distinct().join(vocabulary.select("w"), "w", "left_anti")
    zero = F.lit(0).cast("long").alias("grp")
    refs = vocabulary.select(zero, F.xxhash64("w").alias("ref"), F.col("w").alias("name"), F.lit(None).cast("string").alias("short"), F.array().cast("array<string>").alias("remark"))
    found = map_values(unknown.select(zero, F.col("w").alias("value")), refs).where("ref <> 0").select(F.col("value").alias("w"), "ref")
    fixes = materialise(found.join(refs.select("ref", F.col("name").alias("right")), "ref").select("w", "right"))
    spelt = salted_join(words, fixes, ["w"], "left").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("right", "w").alias("w")))).getField("w").alias("f"), F.count("right").alias("n"))
    return spelt.where("n > 0").select("s", F.array_join("f", "").alias("fixed"))


def candidates(readings: DataFrame, unit: DataFrame) -> DataFrame:
    """s, us, part and d of each reading and unit's name that differ by no more than near() admits, where the name holds all known
    words of the reading; complete, see row_keys(). Readings and names come once each, however many rows and units have them."""

    @F.pandas_udf("array<string>")
    def asked(s: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([row_keys(x, list(k)) for x, k in zip(s, known)])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(us, uw, parts, k) for us, uw, parts in zip(f["us"], f["uw"], f["parts"]) for k in unit_keys(us, list(uw))]
            yield pd.DataFrame(out, columns=["us", "uw", "parts", "k"])

    left = materialise(readings.select("s", "known", F.explode(asked("s", "known")).alias("k")))
    names_ = unit.groupBy(F.col("s").alias("us")).agg(F.min("words").alias("uw"), F.collect_set("part").alias("parts"))
    side = salted_join(spread_by(names_, "us").mapInPandas(read, "us string, uw array<string>, parts array<string>, k string"), left.select("k").distinct(), ["k"], "left_semi", split=False)
    side = materialise(side)
    hits = salted_join(side, left, ["k"])
    hits = hits.where(F.abs(F.length("s") - F.length("us")) <= MOST).where(F.size(F.array_except("known", "uw")) == 0).where(near("s", "us"))
    hits = hits.select("s", "us", F.explode("parts").alias("part"))
    return hits.select("s", "us", "part", F.levenshtein("s", "us").alias("d")).distinct()


def attribute(rows: DataFrame, col: str, official: DataFrame) -> DataFrame:
    """(col, official spelling) of the distinct typed values of rows.col: the nearest official one, null if none is near."""
    refs = official.where("name IS NOT NULL").distinct().select(F.lit(0).cast("long").alias("grp"), F.xxhash64("name").alias("ref"), "name", F.lit(None).cast("string").alias("short"), F.array().cast("array<string>").alias("remark"))
    asked = rows.where(F.col(col).isNotNull()).select(F.lit(0).cast("long").alias("grp"), F.col(col).alias("value")).distinct()
    exact = asked.join(refs.select(F.col("name").alias("value"), F.col("name").alias("same")), "value", "left")
    mapped = map_values(exact.where("same IS NULL").select("grp", "value"), refs).join(refs.select("ref", "name"), "ref").select("value", "name")
    return exact.where("same IS NOT NULL").select("value", F.col("same").alias("name")).unionByName(mapped).select(F.col("value").alias(col), F.col("name").alias(f"{col}_official"))


def near(a: str, b: str) -> Column:
    """Letters of two names within the slips that their length allows (a swap counts two)."""
    n = F.length(b)
    return F.levenshtein(F.col(a), F.col(b)) <= F.when(n < 9, 1).when(n < 16, 3).when(n < 26, 4).otherwise(6)


def cascade(rows: DataFrame, units: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """id, u and rule of each row whose unit one of RULES finds; every rule takes only what the earlier ones left.

    rows: id long, a, b (names), section, town string. units: u, name, section, town string, one row per version; every
    name that a unit ever had counts. A rule takes a row only if exactly one unit fits. Rows that say the same are resolved once.
    Null and empty names match nothing; null sections and towns contradict nothing; repeated rows give one result.

    Rows named by labelled (id, known) are not resolved but judge the rules: such a row comes out once for each rule that finds a
    unit for it, with the attributes hidden that the rule does not join, and with only those readings that no stronger kind of rule
    can use, so that the weak rules are judged by rows that need them. It takes the labels only to tell which rows those are.

    The rules of one kind and part are one join with the units' names by their attributes (exact keys), after which the rows they
    resolved leave by anti-join. Only the last kind compares letters.
    """
    spark = ship(rows.sparkSession)
    section, town = attribute(rows, "section", units.select(F.col("section").alias("name"))), attribute(rows, "town", units.select(F.col("town").alias("name")))
    marked = rows.withColumn("judged", F.lit(False)) if labelled is None else rows.join(labelled.select("id").distinct().withColumn("judged", F.lit(True)), "id", "left").withColumn("judged", F.coalesce("judged", F.lit(False)))
    said = materialise(marked.select("id", "a", "b", "section", "town", "judged", F.xxhash64("a", "b", "section", "town", "judged").alias("sig")).distinct())
    once = said.drop("id").distinct()
    attrs = salted_join(salted_join(once, section, ["section"], "left"), town, ["town"], "left").select("sig", "judged", F.nullif("section_official", F.lit(NONE)).alias("rm"), F.nullif("town_official", F.lit(NONE)).alias("rt"))
    unit = materialise(unit_names(units.select("u", "name", F.col("section").alias("m"), F.col("town").alias("t"))))
    side = materialise(by_attributes(unit))
    rest = materialise(row_names(spread(once)).join(attrs, "sig"))
    won: list[DataFrame] = []

    def left(df: DataFrame) -> DataFrame:
        gone = reduce(DataFrame.unionByName, won).where("NOT judged").select("sig")
        return df.join(gone, "sig", "left_anti")

    def hidden(df: DataFrame, seen: DataFrame, when: Column) -> DataFrame:
        """df without the readings s of judged rows that an earlier rule has a use for."""
        return salted_join(df, seen, ["s"], "left").where(~F.col("judged") | ~F.coalesce(when, F.lit(False))).drop(*[c for c in seen.columns if c != "s"])

    order = F.coalesce(*[F.when(F.col("part") == x, k) for k, x in enumerate(PARTS)])
    exact = materialise(unit.groupBy("s").agg(F.min(order).alias("at")))
    at_shown = F.coalesce(*[F.when(F.col("shown") == x, k) for k, x in enumerate(PARTS)])
    won.append(resolved(hidden(rest, exact, F.col("at") < at_shown).withColumn("us", F.col("s")).withColumn("d", F.col("rank")), side, "nombre"))
    rest = materialise(hidden(left(rest), exact, F.col("at").isNotNull()))
    vocabulary = materialise(unit.select("s", F.explode("words").alias("w")).where("length(w) > 3").groupBy("w").agg(F.count_distinct("s").alias("f")))
    fixed = materialise(repaired(rest.select("s", "words").dropDuplicates(["s"]), vocabulary))
    won.append(resolved(salted_join(rest, fixed, ["s"]).withColumn("us", F.col("fixed")).withColumn("d", F.col("rank")), side, "palabras"))
    mended = fixed.join(exact.select(F.col("s").alias("fixed")), "fixed", "left_semi").select("s", F.lit(True).alias("mended"))
    rest = materialise(hidden(left(rest), mended, F.col("mended")))
    spelt = rest.select("s", "words").dropDuplicates(["s"])
    known = salted_join(spelt.select("s", F.explode("words").alias("w")), vocabulary, ["w"]).groupBy("s").agg(F.array_sort(F.collect_set(F.struct("f", "w"))).getField("w").alias("known"))
    spelt = spread_by(spelt.select("s").join(known, "s", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))), "s")
    pairs = materialise(candidates(spelt, unit))
    near_ones = salted_join(rest, pairs, ["s"]).where("shown IS NULL OR shown = part").drop("shown").withColumnRenamed("part", "shown")
    won.append(resolved(near_ones.withColumn("d", F.col("d") * 2 + F.col("rank")), side, "letras"))
    name = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("k") + 1)
    found = reduce(DataFrame.unionByName, won).select("sig", "judged", "u", name.alias("rule"))
    told = salted_join(said.select("id", "sig", "judged"), found.drop("judged"), ["sig"])
    per = told.groupBy("id", F.when(F.col("judged"), F.col("rule")).alias("by_rule")).agg(F.count_distinct("u").alias("n"), F.min("u").alias("u"), F.min("rule").alias("rule"))
    return per.where("n = 1").select("id", "u", "rule")


def rule_precision(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """rule, n, right and the smoothed share (right + 1) / (n + 2) over the rows whose unit is known (labelled: id, known)."""
    judged = found.join(labelled, "id").groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("u") == F.col("known")).alias("right"))
    return judged.select("rule", "n", "right", ((F.col("right") + 1) / (F.col("n") + 2)).alias("confidence"))


def matched(found: DataFrame, labelled: DataFrame, least: float = 0.5) -> DataFrame:
    """id, u, rule and confidence of the rows that are not labelled. A rule that no labelled row used has 1/2; rules below least give none."""
    rules = rule_precision(found, labelled)
    open_rows = found.join(labelled.select("id"), "id", "left_anti")
    return open_rows.join(F.broadcast(rules.select("rule", "confidence")), "rule", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).where(F.col("confidence") >= least)
