"""Mapping of free-entered values to a canonical list: a BK-tree over the entries under Levenshtein distance."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalspark.llm import names
from fiscalspark.session import materialise, salted_join, ship, spread_by

#: How a value names an entry, best first: short name, name as it is, name with slips, name that was cut.
LETTERS, EXACT, NEAR, CUT = range(4)


class Tree:
    """BK-tree: under the triangle inequality a search skips each branch that cannot hold an entry within the radius."""

    def __init__(self, keys: Iterator[tuple[str, int]]):
        self.root: list | None = None
        for word, ref in keys:
            self.add(word, ref)

    def add(self, word: str, ref: int) -> None:
        if self.root is None:
            self.root = [word, {ref}, {}]
            return
        node = self.root
        while True:
            d = names.close(word, node[0])
            if d == 0:
                node[1].add(ref)
                return
            if d not in node[2]:
                node[2][d] = [word, {ref}, {}]
                return
            node = node[2][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str, set[int]]]:
        """Every entry within radius: (distance, entry, references)."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = names.close(word, node[0])
            if d <= radius:
                out.append((d, node[0], node[1]))
            todo += [child for k, child in node[2].items() if d - radius <= k <= d + radius]
        return out


def run_together(text: str) -> str:
    """All letters and digits of a plain text, joining words too."""
    return re.sub(r"[^a-z0-9]+", "", text)


def allowed(length: int) -> int:
    """Slips that a name of so many letters may have."""
    return 1 if length < 9 else 2 if length < 16 else 3 if length < 26 else 4


class Group:
    """The entries of one group (all of the top level, or those below one entry), as far as a shard holds them.

    What an entry answers to a value depends on the two alone, never on the other entries of the shard: a short form is written
    out with a word of the entry that answers, and whether a word is one of the list is asked of the whole list (see Shard).
    """

    def __init__(self, entries: list[tuple[int, str, str | None]], remarks: tuple[str, ...]):
        self.keys, self.words, self.spelt, self.remarks = [], {}, {}, remarks
        self.letters: dict[str, set[int]] = defaultdict(set)
        self.exact: dict[str, set[int]] = defaultdict(set)
        for ref, name, short in entries:
            text = names.plain(name)
            self.spelt[ref] = names.words(text)
            for key in dict.fromkeys((names.squeeze(text), run_together(text))):
                self.keys.append((key, ref))
                self.exact[key].add(ref)
            if short:
                self.letters[names.squeeze(names.plain(short), False)].add(ref)
        self.words = {ref: set(w) for ref, w in self.spelt.items()}
        self.tree, self.cut = Tree(self.keys), {}
        self.first = sorted({w[0] for w in self.spelt.values() if w})
        self.long: dict[str, set[str]] = defaultdict(set)
        for w in self.words.values():
            for x in w:
                if len(x) > 4:
                    self.long[x[0]].add(x)
        self.turned = [("".join(w[k:] + w[:k]), ref) for ref, w in self.spelt.items() for k in (1, 2, 3) if k < len(w)]

    def find(self, value: str, known: set[str] | None = None) -> list[tuple[int, int, int, list[str]]]:
        """(kind, slips, reference, words) of the entries that value can stand for; words are those of a reading that the entry
        lacks: an entry is none where one of them is a word of the list. With known, all words of the list, that is seen to
        here. What is certain to be beaten by another answer of this group is left out."""
        out: set[tuple[int, int, int, tuple[str, ...]]] = set()
        readings = names.readings(value, self.remarks)
        for i, t in enumerate(readings):
            s = t.replace(".", "").replace(" ", "")
            if s in self.letters and len(s) <= 6:
                out.update((LETTERS, i, r, ()) for r in self.letters[s])
        forms: dict[tuple[str, str, str | None], int] = {}
        for i, t in enumerate(readings):
            for j, (text, need) in enumerate(self._written_out(t)):
                for k, f in enumerate((names.squeeze(text), names.squeeze(text, False), run_together(text))):
                    forms.setdefault((f, text, need), i * 8 + (need is not None) * 4 + k)
        for (f, _, need), rank in forms.items():
            out.update((EXACT, rank, r, ()) for r in self.exact.get(f, ()) if need is None or need in self.words[r])
        if out:
            best = min(x[:2] for x in out)
            return [(*x[:3], list(x[3])) for x in out if x[:2] == best]
        for f, text, need in forms:
            if len(f) >= 5:
                for d, r in self._near(self.tree, f, need):
                    other = tuple(w for w in names.words(text) if d and len(w) > 3 and w not in self.words[r])
                    if known is None or not any(w in known for w in other):
                        out.add((NEAR, d, r, other if known is None else ()))
        if not any(not x[3] for x in out) and len(value) >= 20:
            for f, _, need in forms:
                n = len(f)
                if n >= 15:
                    if n not in self.cut:
                        self.cut[n] = Tree((k[:n], r) for k, r in self.keys + self.turned if len(k) > n)
                    out.update((CUT, d, r, ()) for d, r in self._near(self.cut[n], f, need))
        return [(*x[:3], list(x[3])) for x in out]

    def _written_out(self, text: str) -> list[tuple[str, str | None]]:
        """text, and text with a dotted short form written out as each word of an entry that it can stand for, with that word."""
        m = re.match(r"^([a-z]+)\.?\s+(.*)$", text)
        titled = bool(m) and (m.group(1) in names.HONORIFICS or (text[m.end(1)] == "." and any(names.slips(m.group(1), h) <= 1 for h in names.HONORIFICS)))
        texts = [text, m.group(2)] if titled else [text]
        out: list[tuple[str, str | None]] = [(t, None) for t in texts]
        for t in texts:
            m = re.match(r"^([a-z]+)\.\s*(.*)$", t)
            if m and m.group(1) not in names.SHORT:
                w, rest = m.groups()
                out += [(f"{x} {rest}", x) for x in self.first if x.startswith(w)]
                if len(w) > 2:
                    longer = {v.split()[0] for k, v in names.SHORT.items() if len(k) > 2 and names.slips(w, k) <= 1}
                    out += [(f"{x} {rest}", x) for x in self.first if x in longer or names.slips(w, x[: len(w)]) <= 1 or names.shortens(w, x)]
            for m in re.finditer(r"(?<=[\s/])([a-z]{3,})\.(?=.)", t):
                w = m.group(1)
                if w not in names.SHORT and w not in self.long[w[0]]:
                    out += [(f"{t[: m.start()]}{x}{t[m.end() :]}", x) for x in sorted(self.long[w[0]]) if names.shortens(w, x)]
        return list(dict.fromkeys(out))

    def _near(self, tree: Tree, form: str, need: str | None) -> Iterator[tuple[int, int]]:
        most = allowed(len(form))
        # a swap is one slip and two letters exchanged
        for _, key, refs in tree.within(form, 2 * most):
            d = names.slips(form, key)
            if d <= most:
                yield from ((d, r) for r in refs if need is None or need in self.words[r])


class Shard:
    """Entries of a shard as they are sent to the tasks; a worker process builds each group once, whatever tasks it runs."""

    def __init__(self, rows: list[tuple[int, int, str, str | None, tuple[str, ...]]], known: set[str] | None):
        self.known = known
        self.rows: dict[int, list[tuple[int, str, str | None]]] = defaultdict(list)
        self.remarks: dict[int, tuple[str, ...]] = {}
        for grp, ref, name, short, remark in rows:
            self.rows[grp].append((ref, name, short))
            self.remarks[grp] = tuple(remark or ())
        self.groups: dict[int, Group] = {}

    def find(self, grp: int, value: str) -> list[tuple[int, int, int, list[str]]]:
        if grp not in self.rows:
            return []
        if grp not in self.groups:
            self.groups[grp] = Group(self.rows[grp], self.remarks[grp])
        return self.groups[grp].find(value, self.known)


def list_words(refs: DataFrame) -> DataFrame:
    """w: each word of more than three letters of any entry."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"w": sorted({w for n in f["name"] for w in names.words(names.plain(n)) if len(w) > 3})}, dtype=object)

    return refs.select("name").where("name IS NOT NULL").distinct().mapInPandas(read, "w string").distinct()


FOUND = "grp long, value string, kind int, d int, ref long, other array<string>"


def map_values(values: DataFrame, refs: DataFrame, shard_rows: int = 20_000) -> DataFrame:
    """grp, value and ref (0: no entry) of each distinct value.

    values: grp long, value string. refs: grp long, ref long, name string, short string, remark array<string> (what people
    put behind a name of the group, the same in all rows of it). An entry is looked for within the value's group. Null values
    and groups are left out; empty, blank and very long values are values like others; two entries equally near give none.

    Each shard of at most about ``shard_rows`` entries is sent to all tasks and answers for its entries with all within the
    threshold; the shards' answers are then merged by value: a short name goes before a name as it is, then names with slips, then
    names that were cut. With several shards the words of the list stay distributed and bar an answer after the merge; the result
    is the same for any number of shards. Only distinct values are looked up, so that a value that fills a large part of the
    rows costs one search. The result is written once: several joins read it.
    """
    spark = ship(values.sparkSession)
    asked = spread_by(values.where("grp IS NOT NULL AND value IS NOT NULL").select("grp", "value").distinct(), "grp", "value")
    n = max(1, -(-refs.count() // shard_rows))
    parts = []
    for k in range(n):
        block = refs.where(F.pmod(F.xxhash64("ref"), F.lit(n)) == k).select("grp", "ref", "name", "short", "remark").where("name IS NOT NULL").collect()
        known = {w for r in block for w in names.words(names.plain(r["name"])) if len(w) > 3} if n == 1 else None
        sent = spark.sparkContext.broadcast(Shard([tuple(r) for r in block], known))

        def look(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            shard = sent.value
            for frame in frames:
                out = [(grp, value, *hit) for grp, value in zip(frame["grp"], frame["value"]) for hit in shard.find(grp, value)]
                yield pd.DataFrame(out, columns=["grp", "value", "kind", "d", "ref", "other"])

        parts.append(asked.mapInPandas(look, FOUND))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    if n > 1:
        found = materialise(found)
        hit = ["grp", "value", "kind", "d", "ref", "other"]
        barred = salted_join(found.select(*hit, F.explode("other").alias("w")), materialise(list_words(refs)), ["w"], "left_semi").select(*hit).distinct()
        found = found.join(barred, hit, "left_anti")
    per = found.groupBy("grp", "value", "kind", "d").agg(F.min("ref").alias("lo"), F.max("ref").alias("ref"))
    won = per.groupBy("grp", "value").agg(F.min(F.struct("kind", "d", "lo", "ref")).alias("w")).select("grp", "value", F.when(F.col("w.lo") == F.col("w.ref"), F.col("w.ref")).otherwise(F.lit(0)).alias("ref"))
    return materialise(asked.join(won, ["grp", "value"], "left").select("grp", "value", F.coalesce("ref", F.lit(0)).alias("ref")))
