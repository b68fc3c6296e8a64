"""Texts cut off by field limits: length hazards tested against their neighbours, and endings that go on elsewhere."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fiscalspark.session import materialise, salted_join, ship, spread

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_BLOCK = re.compile(r"</?(?:p|br|div|li|ul|ol|h\d|tr|td|table)\b[^<>]*>", re.I)
#: What a cut can leave behind the last letter: a piece of markup or of a character, or a mark.
_REMNANT = re.compile(r"(?:<[^<>]{0,12}|&#?\w{0,8}|\ufffd+|[ÃÂâ]|\(|-)\Z")
_MARK = re.compile(r"(?:\s*(?:…|\.{3}|\[\s?(?:…|\.{3})\s?\]|\((?:…|\.{3}|sigue|continúa|continua)\)))+\Z", re.I)
#: A full stop ends a sentence at the end of a line or before white space and no small letter.
_STOP = re.compile(r"(?<=[^\s.])[.!?]+[»\")]*(?=\s*\Z|[ \t]*\n|\s+[^\sa-zà-öø-ÿ,;])")
_JOINTS = re.compile(r"[,;:()«»\"¿¡!?]+(?=\s|\Z)|(?<=\s)[(«\"¿¡]+")
_LETTERS = re.compile(r"[\W_]+")
_DIGITS = bytes.maketrans(b"0123456789", b"9999999999")
#: Remnants that no writer leaves: pieces of markup or of a character.
_BROKEN = re.compile(r"[<&\ufffdÃÂâ]")
#: Characters of a text's end that are read at first; more are where no line or sentence begins in them.
TAIL = 400
_SHORT = re.compile(r"(?:s|a|c|u|sr|sra|dr|art|núm|num|ref|s\.a|s\.l|s\.l\.u|s\.a\.u|s\.c|coop|9{1,3}(?:\.9{3})*)\Z")


def plain(text: str) -> str:
    """text without markup and character references, accents composed, every kind of line end as one."""
    t = text
    if "<" in t:
        t = _TAG.sub("", _BLOCK.sub("\n", t))
    if "&" in t:
        t = html.unescape(t)
    if not unicodedata.is_normalized("NFC", t):
        t = unicodedata.normalize("NFC", t)
    return t.replace("\r\n", "\n").replace("\r", "\n") if "\r" in t else t


def tokens(text: str) -> list[str]:
    """Words in small letters with digits as 9, and ','; '.' where a sentence stops, '¶' at the end of a line."""
    t = _STOP.sub("\x01", text).lower().encode("utf-8", "surrogatepass").translate(_DIGITS).decode("utf-8", "surrogatepass")
    t = _JOINTS.sub(" , ", t.replace(". ", " ").replace("\n", " ¶ ")).replace("\x01", " . ")
    return t.split()


def last_tokens(text: str) -> list[str]:
    """The tokens at the end of text, back to one before the line or sentence that is open there and three more at least: all
    that the contexts of the last word are made of."""
    size = TAIL
    while True:
        found = tokens(text[-size:])
        end = len(found)
        while end and found[end - 1] in ".¶,":
            end -= 1
        if size >= len(text) or any(x in ".¶" for x in found[5:end]):
            return found
        size *= 4


class Ending:
    """What stands at the end of a text."""

    __slots__ = ("broken", "doubtful", "marked", "remnant", "stopped", "tokens", "twin")

    def __init__(self, text: str):
        t = plain(text).rstrip()
        while t and t[-1] != "€" and unicodedata.category(t[-1]) in ("So", "Sm", "No", "Cn", "Co", "Cs", "Cf", "Mn") and t[-1] != "\ufffd":
            t = t[:-1].rstrip()
        bare = _MARK.sub("", t[-40:])
        self.marked = len(bare) < len(t[-40:])
        t = (t[:-40] + bare).rstrip()
        self.remnant = self.broken = False
        for _ in range(3):
            m = _REMNANT.search(t)
            if not m or m.start() == 0:
                break
            left = t[: m.start()].rstrip()
            if left[-1:] not in ".!?":
                self.remnant = True
                self.broken = self.broken or bool(_BROKEN.match(m.group()))
            t = left
        self.twin = xxhash.xxh64_intdigest(_LETTERS.sub("", unicodedata.normalize("NFD", t.lower())))
        found = last_tokens(t)
        while found and found[-1] in "¶,":
            found.pop()
        self.stopped = bool(found) and found[-1] == "."
        while found and found[-1] in ".¶":
            found.pop()
        # a full stop behind a short form or a group of digits may stand inside a sentence
        self.doubtful = self.stopped and bool(found) and bool(_SHORT.match(found[-1]))
        self.tokens = found


class Contexts:
    """64-bit numbers of the contexts of many texts at once, by arithmetic on the numbers of their words."""

    P = np.uint64(0x9E3779B97F4A7C15)
    POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))
    KINDS = ("k4", "k3", "kw", "k1", "hy", "hx", "hd", "h3", "h2", "w", "px", "py")
    SALT = {k: np.uint64(xxhash.xxh64_intdigest(k)) for k in KINDS}

    def __init__(self, texts: list[list[str]], cache: dict[str, int]):
        flat: list[str] = []
        for t in texts:
            flat += ("^", "^", "^")
            flat += t
        flat += ("^", "^", "^")
        if len(cache) > 500_000:
            cache.clear()
        for w in set(flat):
            if w not in cache:
                cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, flat), np.uint64, len(flat))
        pad, stop, line = (np.uint64(xxhash.xxh64_intdigest(x)) for x in "^.¶")
        self.bound = (h == pad) | (h == stop) | (h == line)
        self.at = np.flatnonzero(~self.bound)  # the words
        nxt = h[np.minimum(self.at + 1, len(h) - 1)]
        self.how = np.where(nxt == stop, 1, np.where(nxt == line, 2, np.where(nxt == pad, 3, 0))).astype(np.int8)
        a, b, c, d = (h[self.at - k] for k in (3, 2, 1, 0))
        P, S = self.P, self.SALT
        mix = lambda *xs: self._mixed(xs)
        self.k4, self.k3, self.kw, self.k1 = mix(S["k4"], a, b, c, d), mix(S["k3"], b, c, d), mix(S["kw"], a, b, c), mix(S["k1"], d)
        first = self.bound[self.at - 1] if len(self.at) else np.zeros(0, bool)
        self.start = np.flatnonzero(first)  # words that open a segment, as places in at
        seg = np.cumsum(first) - 1
        self.seg = seg
        n = np.bincount(seg, minlength=len(self.start)) if len(self.at) else np.zeros(0, np.int64)
        one = h[self.at[self.start]] if len(self.at) else h[:0]
        later = lambda k: np.where(n > k, h[np.minimum(self.at[self.start] + k, len(h) - 1)], pad) if len(self.at) else h[:0]
        self.h3, self.h2 = mix(S["h3"], one, later(1), later(2)), mix(S["h2"], one, later(1))
        own = self.h2[seg]
        self.hy, self.hx, self.hd = mix(S["hy"], own, b, c, d), mix(S["hx"], own, c, d), mix(S["hd"], own, d)
        self.w = self._sums(h[self.at], self.start) + S["w"]  # the line or sentence up to each word
        # the words before and the letters of the next one: of whole words here, and in letters() of what they begin with
        self.words = [flat[i] for i in self.at]
        b, c = np.where(self.bound[self.at - 1] | self.bound[self.at - 2], pad, b), np.where(self.bound[self.at - 1], pad, c)
        self.before = {"px": (b, c), "py": (own, c)}
        whole = self._letters(self.words)[1]
        self.px, self.py = (mix(S[k], *x, whole) for k, x in self.before.items())
        ends = np.r_[self.start[1:] - 1, len(self.at) - 1] if len(self.at) else np.zeros(0, np.int64)
        self.seg_how, self.last = self.how[ends], ends

    @classmethod
    def _mixed(cls, xs) -> np.ndarray:
        out = xs[1] * cls.P + xs[0]
        for x in xs[2:]:
            out = (out ^ (out >> np.uint64(29))) * cls.P + x
        return out ^ (out >> np.uint64(32))

    @classmethod
    def _sums(cls, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of each run of x, which begin at start, up to each of its places."""
        n = np.diff(np.r_[start, len(x)])
        total = np.cumsum(x * cls.POWERS[(np.arange(len(x)) - np.repeat(start, n)) % 4096], dtype=np.uint64)
        return total - np.repeat(np.r_[np.uint64(0), total][start], n)

    @classmethod
    def _letters(cls, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the words up to each of their letters, of the whole words, and the words' lengths."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        upto = cls._sums((code + np.uint64(1)) * cls.P, np.cumsum(n) - n)
        return upto, upto[np.cumsum(n) - 1], n

    def letters(self, kind: str, sieve: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Keys of the kind (px or py) for all that words begin with; how many words there, of texts' ends too, are longer, and how
        many inside the texts are just that."""
        _, first, of = np.unique(getattr(self, kind), return_index=True, return_inverse=True)
        every, inside = (np.bincount(x, minlength=len(first)) for x in (of, of[self.how < 3]))
        upto, _, n = self._letters([self.words[i] for i in first])
        word, whole = np.repeat(np.arange(len(first)), n), np.zeros(len(upto), bool)
        whole[np.cumsum(n) - 1] = True
        key = self._mixed((self.SALT[kind], *(x[first][word] for x in self.before[kind]), upto))
        if sieve is not None:
            kept = sieve[(key & np.uint64(len(sieve) - 1)).astype(np.int64)]
            key, word, whole = key[kept], word[kept], whole[kept]
        found, inv = np.unique(key.view(np.int64), return_inverse=True)
        longer, same = (np.bincount(inv, np.where(w, x[word], 0), len(found)).astype(np.int64) for w, x in ((~whole, every), (whole, inside)))
        told = longer + same > 0
        return found[told], longer[told], same[told]

    def counted(self, sieve: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """key, and how often it goes on, comes to a full stop, ends the line; ends of texts are left out, and so are keys that the
        sieve (see sieve_of) tells to be wanted by none. For px and py (see letters), longer words count as going on, others as stop."""
        key = np.concatenate([self.k4, self.k3, self.kw, self.k1, self.hy, self.hx, self.hd, self.w, self.h3, self.h2])
        how = np.concatenate([self.how] * 8 + [self.seg_how] * 2)
        kept = how < 3
        if sieve is not None:
            kept &= sieve[(key & np.uint64(len(sieve) - 1)).astype(np.int64)]
        key, how = key[kept].view(np.int64), how[kept]
        found, inv = np.unique(key, return_inverse=True)
        px, py = self.letters("px", sieve), self.letters("py", sieve)
        none = np.zeros(len(px[0]) + len(py[0]), np.int64)
        rest = np.r_[px[1], py[1]], np.r_[px[2], py[2]], none
        return np.r_[found, px[0], py[0]], *(np.r_[np.bincount(inv[how == g], minlength=len(found)), x] for g, x in enumerate(rest))


ENDING = "doc_id long, source string, chars int, bytes int, twin long, stopped boolean, doubtful boolean, marked boolean, remnant boolean, broken boolean, k4 long, k3 long, kw long, k1 long, hy long, hx long, hd long, h3 long, h2 long, w long, px long, py long, same long"


def endings(docs: DataFrame) -> DataFrame:
    """One row per text that is not null or blank, with the contexts at its end; twin is the same for texts that say the same."""
    ship(docs.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for f in frames:
            ends = [Ending(t) for t in f["text"]]
            kept = np.array([bool(e.tokens) for e in ends], bool)
            same = f["same"][kept].to_numpy()
            out = f[["doc_id", "source", "chars", "bytes"]][kept].reset_index(drop=True)
            ends = [e for e in ends if e.tokens]
            c = Contexts([e.tokens for e in ends], cache)
            at = np.flatnonzero(c.how == 3)
            seg = c.seg[at]
            out["twin"] = np.array([e.twin for e in ends], np.uint64).view(np.int64)
            for k in ("stopped", "doubtful", "marked", "remnant", "broken"):
                out[k] = np.array([getattr(e, k) for e in ends], bool)
            for k in ("k4", "k3", "kw", "k1", "hy", "hx", "hd"):
                out[k] = getattr(c, k)[at].view(np.int64)
            for k in ("h3", "h2"):
                out[k] = getattr(c, k)[seg].view(np.int64)
            for k in ("w", "px", "py"):
                out[k] = getattr(c, k)[at].view(np.int64)
            out["same"] = same
            yield out

    rows = docs.select(F.col("doc_id").cast("long"), "source", "text", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("same")).where("text IS NOT NULL AND length(trim(text)) > 0")
    return spread(rows).mapInPandas(read, ENDING)


def sieve_of(wanted: DataFrame, bits: int = 1 << 24) -> np.ndarray:
    """A table of ``bits`` places in which the places of all wanted keys are marked: what is not marked is not wanted. Its size does not
    depend on the number of keys; each task fills its own and they are put together in few tasks."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for b in batches:
            table[b.column(0).to_numpy() & (bits - 1)] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(table).tobytes()]}, pa.schema([("bits", pa.binary())]))

    parts = wanted.select("key").coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator()
    table = np.zeros(bits // 8, np.uint8)
    for r in parts:
        table |= np.frombuffer(bytes(r.bits), np.uint8)
    return table


def once(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """text of docs, each once: a text that is delivered again tells nothing about how words go on. Only texts that ends (endings of
    docs) has more than once are put together; the others stay where they are if a count shows that the former can be sent."""
    rows = docs.select("text", F.xxhash64("text").alias("same")).where("text IS NOT NULL AND length(trim(text)) > 0")
    again = materialise(ends.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"))
    single = salted_join(rows, again, ["same"], "left_anti", broadcast_rows=500_000, split=False)
    several = salted_join(rows, again, ["same"], "left_semi", broadcast_rows=500_000, split=False).groupBy("same").agg(F.min("text").alias("text"))
    return single.select("text").unionByName(several.select("text"))


def occurrences(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """key, goes_on, stop, line: how often each context inside the texts goes on in its sentence, comes to the full stop or to
    the end of a line. What stands at a text's end is not counted. Counted by batch here; the same key comes again. With wanted
    (key) only contexts that may be among them are given."""
    spark = ship(docs.sparkSession)
    sent = None if wanted is None else spark.sparkContext.broadcast(sieve_of(wanted))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        sieve = None if sent is None else np.unpackbits(sent.value).astype(bool)
        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), 2000):
                c = Contexts([tokens(plain(t)) for t in texts[k : k + 2000]], cache)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c.counted(sieve)], names=["key", "goes_on", "stop", "line"])

    rows = docs.select("text").where("text IS NOT NULL AND length(trim(text)) > 0")
    return spread(rows).mapInArrow(read, "key long, goes_on long, stop long, line long")


def poisson_tail(n: int, mean: float) -> float:
    """P(X >= n) for a Poisson count with this mean."""
    if n <= 0:
        return 1.0
    log_p, total, k = -mean + n * math.log(mean) - math.lgamma(n + 1), 0.0, n
    while True:
        p = math.exp(log_p)
        total += p
        k += 1
        log_p += math.log(mean) - math.log(k)
        if k > mean and p < total * 1e-12 or p == 0.0 and k > mean:
            return min(1.0, total)


def length_limits(ends: DataFrame, reach: int = 20, fdr: float = 0.01) -> DataFrame:
    """source, unit ('chars' or 'bytes'), len, n, expected and q of the lengths at which more texts end than nearby.

    The hazard of a length is the share of the texts at least so long that end there. It is tested against the
    pooled hazard of the ``reach`` lengths on either side, whether a text ends at them or not: the texts that end there by the sum
    of those that are at least so long (Poisson tail, half a text added); q controls the false discovery
    rate over all lengths of all sources (Benjamini and Hochberg). Counts are aggregated first: windows run over lengths.
    """
    counts = ends.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("len")))).alias("x")).groupBy("source", "x.unit", "x.len").agg(F.count("*").alias("n"))
    per = Window.partitionBy("source", "unit")
    by = per.orderBy("len")
    near = by.rangeBetween(-reach, reach)
    upto = lambda c, k: F.coalesce(F.sum(c).over(by.rangeBetween(Window.unboundedPreceding, k)), F.lit(0))
    # texts of at least x characters, summed over x = 1 to y, are the sum of min(length, y): no axis of lengths is needed
    summed = lambda y, k: upto(F.col("n") * F.col("len"), k) + y * (F.sum("n").over(per) - upto("n", k))
    hazards = (
        counts.withColumn("risk", F.sum("n").over(per) - upto("n", -1))
        .withColumn("nearby", F.sum("n").over(near) - F.col("n"))
        .withColumn("exposed", summed(F.col("len") + reach, reach) - summed(F.greatest(F.col("len") - reach - 1, F.lit(0)), -reach - 1) - F.col("risk"))
    )
    # without a text that reaches another length nearby there is nothing to test against
    expected = F.try_divide(F.col("risk") * (F.col("nearby") + 0.5), F.col("exposed"))

    @F.pandas_udf("double")
    def tail(n: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([poisson_tail(int(a), float(b)) for a, b in zip(n, mean)])

    hazards = materialise(hazards)
    tested = hazards.withColumn("expected", expected).where("n > 2 AND n > expected").withColumn("p", tail(F.col("n"), F.col("expected")))
    return significant(tested, hazards.count(), fdr).select("source", "unit", "len", "n", "expected", "q")


def significant(tested: DataFrame, m: int, fdr: float) -> DataFrame:
    """tested (p) with q, the least false discovery rate over m tests at which the row is significant (Benjamini and Hochberg),
    where that is at most fdr.

    Rows are ordered by range partitions. A row's rank is its place in its partition and the rows of the partitions before; q is
    the least p * m / rank from its place on, within the partition and over those behind. Only one row a partition is put together.
    """
    placed = materialise(tested.repartitionByRange("p", *tested.columns).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy("p", *tested.columns)
    ranked = placed.withColumn("own", F.row_number().over(own))
    sizes = {r.part: r.c for r in placed.groupBy("part").agg(F.count("*").alias("c")).collect()}
    before, offsets = 0, {}
    for k in sorted(sizes):
        offsets[k] = before
        before += sizes[k]
    if not offsets:
        return tested.withColumn("q", F.lit(None).cast("double")).limit(0)
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part"))
    scored = materialise(ranked.withColumn("s", F.col("p") * m / (F.col("own") + offset)))
    least = {r.part: r.s for r in scored.groupBy("part").agg(F.min("s").alias("s")).collect()}
    behind, after = float("inf"), {}
    for k in sorted(least, reverse=True):
        after[k] = behind
        behind = min(behind, least[k])
    rest = F.element_at(F.create_map(*[F.lit(x) for kv in after.items() for x in kv]), F.col("part"))
    q = F.least(F.min("s").over(own.rowsBetween(Window.currentRow, Window.unboundedFollowing)), rest)
    return scored.withColumn("q", q).where(F.col("q") <= fdr).select(*tested.columns, "q")


KEYS = Contexts.KINDS


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, source, limit, limite, rotura and cut (either) of every text that is not null or blank.

    limit: the text has a length at which its source ends too many texts (length_limits). limite: it has, and its ending is
    incomplete; so many texts are there because of the limit that an ending is taken for incomplete unless the corpus shows that
    it can be one. rotura: its end is none elsewhere; breaks of a transfer have no length, so the corpus must show that the
    text goes on. A text ends where its last words, or the line or sentence that they close, end elsewhere in the corpus
    without full stop; it goes on if they go on there, if its last word occurs nowhere else, or if a sentence like its last
    one always comes to a full stop. Counts cover all texts; only contexts that stand at the end of some doubtful text are
    kept, and texts that say the same count once as an end.
    """
    ends = materialise(endings(docs))
    limits = materialise(length_limits(ends.dropDuplicates(["source", "chars", "bytes", "twin"])).select("source", "unit", "len").withColumn("hit", F.lit(True)))
    placed = ends
    for u in ("chars", "bytes"):
        placed = salted_join(placed, limits.where(F.col("unit") == u).select("source", F.col("len").alias(u), F.col("hit").alias(f"at_{u}")), ["source", u], "left").withColumn(f"at_{u}", F.coalesce(f"at_{u}", F.lit(False)))
    open_ends = placed.where("NOT stopped OR doubtful")
    asked = open_ends.select("doc_id", "twin", "stopped", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KEYS])).alias("a")).select("doc_id", "twin", "stopped", "a.kind", "a.key")
    wanted = materialise(asked.select("key").distinct())
    inside = salted_join(occurrences(once(docs, ends), wanted), wanted, ["key"], "left_semi", broadcast_rows=500_000, split=False).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("goes_on", "stop", "line")])
    final = asked.where("NOT stopped").select("key", "twin").distinct().groupBy("key").agg(F.count("*").alias("last"))
    stats = materialise(inside.join(final, "key", "full").na.fill(0))
    told = salted_join(asked, stats, ["key"], "left").na.fill(0, ["goes_on", "stop", "line", "last"])
    cell = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}")
    wide = told.groupBy("doc_id").agg(*[cell(k, c) for k in KEYS for c in ("goes_on", "stop", "line", "last")])
    counted = [F.col(x) for k in ("k1", "k3", "k4") for x in (f"{k}_goes_on", f"{k}_stop", f"{k}_line", f"{k}_last")] + [F.col(f"{k}_{c}") for k in ("px", "py") for c in ("goes_on", "stop", "last")]
    # written with each share worked out, so that the code of the verdict stays small
    shares = [x.alias(f"{k}_{c}") for k in KEYS for c, x in zip(("n", "s"), share_of(k))]
    seen = materialise(materialise(wide).select("doc_id", *shares, *counted).join(open_ends, "doc_id"))
    # a length at which most texts are complete by their form is a length that titles happen to have
    endless = materialise(placed.where("at_chars OR at_bytes").join(seen.select("doc_id", complete_form().alias("form")), "doc_id", "left").select("source", "chars", "bytes", "at_chars", "at_bytes", (~F.col("stopped") & ~F.coalesce("form", F.lit(False))).alias("open")))
    for u in ("chars", "bytes"):
        true = endless.where(f"at_{u}").groupBy("source", u).agg(F.count_if("open").alias("o"), F.count("*").alias("n")).where("o * 2 > n").select("source", u, F.lit(True).alias(f"true_{u}"))
        placed = salted_join(placed, true, ["source", u], "left").withColumn(f"at_{u}", F.coalesce(f"true_{u}", F.lit(False)) & F.col(f"at_{u}")).drop(f"true_{u}")
    placed = placed.withColumn("limit", F.col("at_chars") | F.col("at_bytes"))
    told = seen.drop("source").join(placed.select("doc_id", "limit"), "doc_id").select("doc_id", incomplete().alias("cut"))
    both = placed.join(told, "doc_id", "left").select("doc_id", "source", "limit", F.coalesce("cut", F.lit(False)).alias("cut"))
    return both.select("doc_id", "source", "limit", (F.col("limit") & F.col("cut")).alias("limite"), (~F.col("limit") & F.col("cut")).alias("rotura"), "cut")


def share_of(k: str) -> tuple[Column, Column]:
    """Occurrences of context k besides the text itself, and the share of them that end there without full stop."""
    on, stop, line, last = (F.col(f"{k}_{c}") for c in ("goes_on", "stop", "line", "last"))
    others = on + stop + line + F.greatest(last - 1, F.lit(0))
    return others, F.try_divide(line + F.greatest(last - 1, F.lit(0)), others)


def share(k: str) -> tuple[Column, Column]:
    """share_of k where it is worked out already."""
    return F.col(f"{k}_n"), F.col(f"{k}_s")


def first_known(kinds: tuple[str, ...], least: int) -> Column:
    """Share of the first of the contexts that occurs at least so often elsewhere; null if none does."""
    out = F.lit(None).cast("double")
    for k in reversed(kinds):
        n, s = share(k)
        out = F.when(n >= least, s).otherwise(out)
    return out


def complete_form(least: int = 5) -> Column:
    """Whether the text's ending is surely one: its last line or sentence is one that elsewhere ends so, or begins like lines that end
    without full stop and closes with words that close such lines."""
    whole_n, whole = share("w")
    head, within = first_known(("h3", "h2"), least), first_known(("hy", "hx", "hd"), 3)
    return F.coalesce(~divided() & (((whole_n >= least) & (whole > 0.5) & ~repeated(whole_n)) | ((head > 0.8) & (within.isNull() | (within >= 0.3)))), F.lit(False))


def divided(least: int = 10) -> Column:
    """Whether the last word is the beginning of longer ones that stand in its place, and hardly ever a word there itself. Not a matter
    of size: texts that were cut at the same place make it no word, however many they are."""
    as_word = lambda k: F.col(f"{k}_stop") + F.greatest(F.col(f"{k}_last") - 1, F.lit(0))
    return reduce(Column.__or__, [F.coalesce((F.col(f"{k}_goes_on") >= least) & (as_word(k) * 20 <= F.col(f"{k}_goes_on")), F.lit(False)) for k in ("px", "py")])


def repeated(whole_n: Column) -> Column:
    """Whether the last line begins like many more lines that go on: then texts were cut at the same place of it."""
    n3, s3 = share("h3")
    return F.coalesce((n3 >= 5 * whole_n) & (s3 < 0.1), F.lit(False))


def incomplete(least: int = 5) -> Column:
    """Whether the text's ending is incomplete, from how its contexts go on elsewhere.

    h3, h2: how lines and sentences that begin so end; w: how those that begin with all words of the last one do, and whether they
    go on; px, py: words that begin as the last one, behind the same two words, or behind the same word in a line that begins so; hy, hx, hd: how such a line goes on after its
    last three, two or one words; k4, k3, kw, k1: how any line goes on after the last words. At a limit, and behind a mark such as
    '…', less evidence is needed. Lines of a form that ends without full stop (titles, lists) are judged by their last two words:
    one word alone stands at several places of a list, and a rare one may never have closed one yet.
    """
    loose = F.col("limit") | F.col("marked") | F.col("remnant")
    whole_n, whole = share("w")
    cut_there = repeated(whole_n)
    head, tail = F.when(cut_there, first_known(("h3", "h2"), least)).otherwise(first_known(("w", "h3", "h2"), least)), first_known(("k4", "k3", "kw"), least)
    form = F.coalesce(head > 0.8, F.lit(False))
    hd_n, hd = share("hd")
    within = F.coalesce(first_known(("hy", "hx"), 3), F.when(hd_n >= F.when(form, 10).otherwise(3), hd))
    unseen = F.col("k1_goes_on") + F.col("k1_stop") + F.col("k1_line") == 0
    no_stop = (
        F.when(divided(), True)
        .when((whole_n >= least) & (whole > 0.5) & ~cut_there, False)
        .when(F.col("broken"), True)
        .when(head < F.when(loose, 0.5).otherwise(0.3), True)
        .when(unseen & (F.col("k1_last") <= 2) & (tail.isNull() | (tail < 0.9)), True)
        .when(unseen & head.isNull() & tail.isNull(), True)
        .when(form & within.isNotNull(), within < F.when(loose, 0.3).otherwise(0.05))
        .when(head.isNotNull() & within.isNotNull(), within < F.when(loose, 0.3).otherwise(0.15))
        .when(form & (share("h2")[0] >= 100) & (hd_n == 0) & (unseen | loose), True)
        .when(form, False)
        .when(tail < F.when(loose, 0.5).otherwise(0.2), True)
        .when(tail.isNull() & head.isNull(), loose)
        .otherwise(False)
    )
    n4, n3 = share("k4")[0], share("k3")[0]
    stops = F.when(n4 >= 10, F.try_divide(F.col("k4_stop"), n4)).when(n3 >= 10, F.try_divide(F.col("k3_stop"), n3))
    return F.coalesce(F.when(F.col("stopped"), stops < 0.02).otherwise(no_stop), F.lit(False))


def truncated(docs: DataFrame) -> DataFrame:
    """doc_id of the texts that were cut inside a word or sentence. Null and blank texts are not cut; see judged."""
    return judged(docs).where("cut").select("doc_id")


def truncation_rates(docs: DataFrame) -> DataFrame:
    """source with its texts, those cut, those of them at a limit of the source and those broken off elsewhere, and the rate."""
    n = judged(docs).groupBy("source").agg(F.count("*").alias("n"), F.count_if("cut").alias("cut"), F.count_if("limite").alias("at_limit"), F.count_if("rotura").alias("broken"))
    return n.withColumn("rate", F.col("cut") / F.col("n"))
