"""Evaluation texts leaking into training text: template windows joined by hash, slots held against the item's own."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalspark.llm.names import slips
from fiscalspark.llm.truncation import plain
from fiscalspark.session import materialise, ship, spread

#: Words in a template window, words of an item that a passage must hold, and how many of them may differ.
WINDOW, PASSAGE, EDITS = 4, 20, 2
#: Words of an item that its windows cover at least within one stretch of a text that holds a passage: all it keeps, but for
#: two runs that are too short for a window (EDITS changes leave EDITS + 1 runs). Stretches end at a gap.
COVERED, GAP = PASSAGE - EDITS - EDITS * (WINDOW - 1), 25
#: Words by which a passage may run ahead of the item or behind it, divided words and added ones together.
DRIFT = 12
#: Words in a row that a passage always keeps whole, however its EDITS lie.
RUN = (PASSAGE - EDITS) // (EDITS + 1)
#: A window at more places than this is a turn of phrase: it brings up an item only where RUN words in a row are the item's.
SHARED = 20
#: Placeholders of figures, names and units in templates.
SLOTS = frozenset("#@$")
#: Units of measure.
UNITS = {"euros", "euro", "eur", "ciento", "meses", "mes", "dias", "dia", "veces", "horas", "years", "months", "percent"}

_DIVIDED = re.compile(r"(?<=\w)[-­‐](?:[ \t]*\n\s*|[ \t]+)(?=\w)")
_ACCENT = re.compile(r"[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u20d0-\u20ff]+")
_EDGE = re.compile(r"[^\w]+|_+")


def letters_of(raw: str) -> str:
    """Letters and digits of a word without accents, in small letters."""
    flat = unicodedata.normalize("NFD", raw.lower())
    flat = flat if flat.isascii() else _ACCENT.sub("", flat)
    return flat if flat.isalnum() else _EDGE.sub("", flat)


def is_big(raw: str) -> bool:
    """Whether a word begins with a capital without being in capitals throughout."""
    return (raw[0] if raw[0].isalpha() else raw.lstrip("«\"'(¿¡[*_")[:1]).isupper() and not (len(raw) > 2 and raw.isupper())


def raw_words(text: str) -> list[str]:
    """The words of text as they stand, those divided at a hyphen put together."""
    return _DIVIDED.sub("", plain(text)).split()


def words_of(text: str) -> tuple[list[str], list[bool]]:
    """The words of text as letters and digits only, and whether each begins with a capital."""
    both = [(x, is_big(r)) for r in raw_words(text) if (x := letters_of(r))]
    return [x for x, _ in both], [b for _, b in both]


def names_in(text: str) -> tuple[set[str], set[str]]:
    """Words of text that begin with a capital behind its first word, and words in small letters."""
    w, big = words_of(text)
    plain_ones = [x for x in zip(range(len(w)), w, big) if not any(c.isdigit() for c in x[1])]
    return {x for k, x, b in plain_ones if b and k}, {x for r in raw_words(text) if r[:1].islower() and (x := letters_of(r))}


def kind(w: str, names: set[str] | dict) -> str:
    """A word as its template has it: a figure, name or unit as placeholder, any other word as it is."""
    if any(c.isdigit() for c in w):
        return "#"
    if w in names:
        return "@"
    return "$" if w in UNITS else w


class Phrase:
    """A window of more than SHARED places: by item, and by the words that follow it up to RUN words."""

    def __init__(self, places: list[tuple[int, int]], items: list[list[str]]):
        self.by_item: dict[int, list[int]] = defaultdict(list)
        self.longer: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for n, q in places:
            self.by_item[n].append(q)
            self.longer[tuple(items[n][q + WINDOW : q + RUN])].append((n, q))


class Items:
    """Template windows of a block of items: template to slot values to places. Words that a text divides or runs together count
    as the item has them, so passages bring up windows as if they were written right. What is found of an item depends on the
    item alone: names are those of the whole list, and no window is left out for standing in many items."""

    def __init__(self, items: list[tuple[int, str]], known_names: set[str] | None = None):
        if known_names is None:
            found = [names_in(t) for _, t in items]
            known_names = set().union(*(x for x, _ in found)) - set().union(*(x for _, x in found)) if found else set()
        self.names = known_names
        self.ids = [i for i, _ in items]
        self.words = [words_of(t)[0] for _, t in items]
        self.kinds = [[kind(x, self.names) for x in w] for w in self.words]
        self.known = {x for w in self.words for x in w}
        self.kind = {x: kind(x, self.names) for x in self.known}
        windows: dict[tuple, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, w in enumerate(self.words):
            for p in range(len(w) - WINDOW + 1):
                template, slots = self.template(tuple(w[p : p + WINDOW]))
                windows[template][slots].append((n, p))
        self.windows = {k: {x: at if len(at) <= SHARED else Phrase(at, self.words) for x, at in v.items()} for k, v in windows.items()}
        # words and pairs of neighbours, by which divided words of a text are rejoined and words run together are split
        self.pairs: dict[str, set[tuple[str, str]]] = defaultdict(set)
        for w in self.words:
            for x, y in zip(w, w[1:]):
                self.pairs[x + y].add((x, y))
        # what a word of a text can be: 1 a word of an item, 2 the front of one, 4 two run together
        self.role: dict[str, int] = defaultdict(int)
        for x in self.known:
            self.role[x] |= 1
            for k in range(1, len(x)):
                self.role[x[:k]] |= 2
        for x in self.pairs:
            self.role[x] |= 4
        self.role = dict(self.role)
        self.read: dict[str, tuple[str, int]] = {}

    def template(self, own: tuple[str, ...]) -> tuple[tuple, tuple]:
        k = tuple(map(self.kind.__getitem__, own))
        return k, tuple(x for x, y in zip(own, k) if y in SLOTS)

    def places(self, own: tuple[str, ...]) -> list[tuple[int, int]] | Phrase | None:
        """Where the items have these WINDOW words: the template joined first, then its slots."""
        template, slots = self.template(own)
        return self.windows.get(template, {}).get(slots)

    def readings(self, w: list[str], roles: list[int]) -> dict[int, list[tuple[tuple[str, ...], int]]]:
        """Places of a text where its words can be read otherwise: words of an item, and the words of the text that they take."""
        out: dict[int, list[tuple[tuple[str, ...], int]]] = {}
        known, n = self.known, len(w)
        for p, role in enumerate(roles):
            if role & 2 and p + 1 < n:
                xy = w[p] + w[p + 1]
                if xy in known:
                    out.setdefault(p, []).append(((xy,), 2))
                if p + 2 < n and xy + w[p + 2] in known:
                    out.setdefault(p, []).append(((xy + w[p + 2],), 3))
            if role & 4:
                out.setdefault(p, []).extend((pair, 1) for pair in sorted(self.pairs[w[p]]))
        return out

    def reread(self, w: list[str], roles: list[int]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """Place and words (RUN, or as many as there are of at least WINDOW) of every reading that has a divided word or one run
        together in it. A pair may reach over either end."""
        other = self.readings(w, roles)
        seen = set()
        for p in sorted({at for q in other for at in range(max(0, q - 3 * (RUN - 1)), q + 1)}):
            todo: list[tuple[tuple[str, ...], int, bool]] = [((), p, False)]
            while todo:
                own, at, changed = todo.pop()
                if changed and len(own) >= WINDOW and (p, own[:RUN]) not in seen:
                    seen.add((p, own[:RUN]))
                    yield p, own[:RUN]
                if len(own) >= RUN or at >= len(w):
                    continue
                if roles[at] & 1:
                    todo.append(((*own, w[at]), at + 1, changed))
                for got, taken in other.get(at, ()):
                    todo.append(((*own, *got), at + taken, True))
                    if not own and len(got) == 2:
                        todo.append((got[1:], at + taken, True))

    def text_words(self, text: str) -> tuple[list[str], list[int], list[str]]:
        """Words of text, what each can be (see role), and the words as they stand."""
        if len(self.read) > 500_000:
            self.read.clear()
        read, raw = self.read, raw_words(text)
        for r in raw:
            if r not in read:
                x = letters_of(r)
                read[r] = (x, self.role.get(x, 0))
        both = [read[r] for r in raw]
        kept = [x for x in zip(both, raw) if x[0][0]]
        return [x[0] for x, _ in kept], [x[1] for x, _ in kept], [r for _, r in kept]

    def leaked(self, text: str) -> list[int]:
        """Ids of the items of which text holds a passage."""
        w, roles, raw = self.text_words(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        phrases: list[tuple[int, dict[int, list[int]]]] = []

        def note(p: int, own: tuple[str, ...]) -> None:
            at = self.places(own[:WINDOW])
            if isinstance(at, Phrase):
                phrases.append((p, at.by_item))
                for n, q in at.longer.get(own[WINDOW:], ()) if len(own) == RUN else ():
                    hits[n].append((p, q))
            else:
                for n, q in at or ():
                    hits[n].append((p, q))

        run = 0
        for p, role in enumerate(roles):
            run = run + 1 if role & 1 else 0
            if run >= WINDOW:
                at = p - WINDOW + 1
                note(at, tuple(w[at : at + RUN]))
        for p, own in self.reread(w, roles):
            note(p, own)
        if not hits:
            return []
        out = []
        for n, found in hits.items():
            found += [(p, q) for p, at in phrases for q in at.get(n, ())]
            if len(found) * WINDOW >= COVERED and self._holds(n, sorted(found), w, raw):
                out.append(self.ids[n])
        return out

    def _holds(self, n: int, found: list[tuple[int, int]], w: list[str], raw: list[str]) -> bool:
        stretch: list[tuple[int, int]] = []
        for hit in [*found, (1 << 40, 0)]:
            if stretch and hit[0] - stretch[-1][0] > GAP:
                if promising(stretch):
                    lo, hi = max(0, stretch[0][0] - GAP), stretch[-1][0] + 3 * WINDOW + GAP
                    if passage(self.words[n], self.kinds[n], w[lo:hi], [kind(x, self.names) for x in w[lo:hi]], [is_big(r) for r in raw[lo:hi]]):
                        return True
                stretch = []
            stretch.append(hit)
        return False


def promising(stretch: list[tuple[int, int]]) -> bool:
    """Whether COVERED words of some PASSAGE consecutive words of the item stand in their order in one place of the text."""
    for p, q in stretch:
        own: set[int] = set()
        for a, b in stretch:
            if q <= b <= q + PASSAGE - WINDOW and abs((a - b) - (p - q)) <= DRIFT:
                own.update(range(b, b + WINDOW))
                if len(own) >= COVERED:
                    return True
    return False


def misspelt(w: str) -> int:
    """Slips after which a figure or name still is the same one: none in a short figure, one in a long figure or short name."""
    if any(c.isdigit() for c in w):
        return int(len(w) > 4)
    return 1 if len(w) < 6 else 2


def passage(item: list[str], item_kinds: list[str], text: list[str], text_kinds: list[str], big: list[bool]) -> bool:
    """Whether text holds PASSAGE consecutive words of item with at most EDITS of them replaced, misspelt, left out or added.

    Words are aligned locally; a word that is divided in the text, or run together with the next, is no difference. A
    figure or name of the item in whose place the text has another figure or name makes the place unfit: the passage is the
    template with other values.
    """
    m, n = len(item), len(text)
    own = set(item)
    two = [None, *(x + y if x + y in own else None for x, y in zip(text, text[1:]))] if n else []
    three = [None, None, *(x + y + z if x + y + z in own else None for x, y, z in zip(text, text[1:], text[2:]))][:n]
    score = [[0] * (n + 1) for _ in range(m + 1)]
    back = [[(0, 0)] * (n + 1) for _ in range(m + 1)]
    top, end = 0, (0, 0)
    for i, x in enumerate(item, 1):
        row, up, steps = score[i], score[i - 1], back[i]
        pair = item[i - 2] + x if i > 1 else None
        left = 0
        for j, y in enumerate(text, 1):
            if x == y:
                best, step = up[j - 1] + 2, (1, 1)
            else:
                best, step = up[j - 1] - 1, (1, 1)
                if up[j] - 1 > best:
                    best, step = up[j] - 1, (1, 0)
                if left - 1 > best:
                    best, step = left - 1, (0, 1)
                if x == two[j - 1]:
                    if up[j - 2] + 2 > best:
                        best, step = up[j - 2] + 2, (1, 2)
                elif x == three[j - 1]:
                    if up[j - 3] + 2 > best:
                        best, step = up[j - 3] + 2, (1, 3)
                elif pair == y and score[i - 2][j - 1] + 4 > best:
                    best, step = score[i - 2][j - 1] + 4, (2, 1)
            if best > 0:
                row[j] = left = best
                steps[j] = step
                if best > top:
                    top, end = best, (i, j)
            else:
                left = 0
    cost: list[float] = []  # of the item's words along the path, last first
    i, j = end
    lost: list[int] = []  # places of the item and the text in the present run of differences
    extra: list[int] = []

    def unfit() -> bool:
        for a in lost:
            if item_kinds[a] not in "#@":
                continue
            for b in extra:
                other = text_kinds[b] == "#" if item_kinds[a] == "#" else (text_kinds[b] == "@" or (big[b] and text_kinds[b] not in "#$"))
                if other and slips(item[a], text[b]) > misspelt(item[a]):
                    return True
        return False

    run = 0
    while i > 0 and j > 0 and score[i][j] > 0:
        di, dj = back[i][j]
        if (di, dj) == (1, 1) and item[i - 1] == text[j - 1] or di + dj > 2:
            if run and unfit():
                cost[len(cost) - 1] += EDITS + 1
            lost, extra, run = [], [], 0
            cost += [0.0] * di
        else:
            run += 1
            if di:
                lost.append(i - 1)
                cost.append(1.0)
            elif cost:
                cost[-1] += 1.0
            if dj:
                extra.append(j - 1)
        i, j = i - di, j - dj
    # words of the item just outside the path may be the ones left out or replaced
    cost = [1.0] * min(EDITS, m - end[0]) + cost + [1.0] * min(EDITS, i)
    if len(cost) < PASSAGE:
        return False
    total = sum(cost[:PASSAGE])
    for k in range(PASSAGE, len(cost) + 1):
        if total <= EDITS:
            return True
        if k < len(cost):
            total += cost[k] - cost[k - PASSAGE]
    return False


class Block:
    """Items of a block as they are sent to the tasks; a worker process builds the index once, whatever tasks it runs."""

    def __init__(self, items: list[tuple[int, str]], known_names: set[str]):
        self.items, self.known_names, self.built = items, known_names, None

    def index(self) -> Items:
        if self.built is None:
            self.built = Items(self.items, self.known_names)
        return self.built


def names_of(items: DataFrame) -> set[str]:
    """Names in the whole list: words that some item writes with a capital inside a sentence and none in small letters. They are no
    more than the words of the list, which grow far less than the list."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            both = [names_in(t) for t in f["text"]]
            big, small = (set().union(*(x[k] for x in both)) for k in (0, 1))
            yield pd.DataFrame([(w, True) for w in sorted(big)] + [(w, False) for w in sorted(small)], columns=["w", "big"])

    rows = items.mapInPandas(read, "w string, big boolean").groupBy("w").agg(F.min("big").alias("big"))
    return {r.w for r in rows.where("big").select("w").collect()}


def leaks(docs: DataFrame, items: DataFrame, block: int = 5_000) -> DataFrame:
    """doc_id and item_id of every text that gives away an item.

    docs: doc_id long, text string. items: item_id long, text string. Null, empty and blank texts give nothing away and are
    not given away, nor is an item of fewer than PASSAGE words; very long texts are searched whole; repeated rows give one
    result. Items go to the tasks in blocks of about ``block``, each block against all texts, so a text is never shuffled; the
    result is the same for any size of block.
    """
    spark = ship(docs.sparkSession)
    whole = materialise(items.where("item_id IS NOT NULL AND length(text) > 0").select("item_id", "text").distinct())
    n = max(1, -(-whole.count() // block))
    known_names = names_of(whole)
    rows = spread(docs.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = None
    for b in range(n):
        part = whole.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        sent = spark.sparkContext.broadcast(Block([(r.item_id, r.text) for r in part.collect()], known_names))

        def search(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = sent.value.index()
            for f in frames:
                found = [(d, i) for d, t in zip(f["doc_id"], f["text"]) for i in index.leaked(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id"])

        one = rows.mapInPandas(search, "doc_id long, item_id long")
        out = one if out is None else out.unionByName(one)
    return out.distinct()
