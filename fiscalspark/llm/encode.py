"""Encoding of a corpus with a public byte-level BPE: short texts by batch, long unsplit text by tree concatenation."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalspark.session import ship, spread

#: Folder of the public vocabulary files, and the name of the one that p7 asks for.
TOKENIZERS = os.environ.get("FISCALSPARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of up to PIECE characters are encoded at once; longer ones are spread in pieces of about this length.
PIECE = 1 << 16


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a vocabulary file; one a worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sent_file(spark, path: str) -> str:
    """Send the vocabulary file with the session, so that executors need no folder of their own for it; gives its name."""
    sc = spark.sparkContext
    sent = getattr(sc, "_fiscalspark_files", None) or set()
    if path not in sent:
        sc.addFile(path)
        sc._fiscalspark_files = sent | {path}
    return os.path.basename(path)


def sent_encoder(name: str):
    """The encoder in a task, from the file that came with the session."""
    from pyspark import SparkFiles

    return encoder(SparkFiles.get(name))


def cut_points(text: str, piece: int) -> list[int]:
    """Places where text can be cut without changing its encoding, at least piece characters apart where possible.

    A character that is no white space followed by white space always ends a word of the pattern, and nothing behind
    that place changes the words before it. Where there is no such place within 2 * piece the text is cut at word
    ends of the pattern or, inside one word longer than piece, in halves of halves; those joins have to be mended.
    """
    cuts, at = [0], 0
    safe = regex.compile(r"(?<=\S)(?=\s)")
    while len(text) - at > 2 * piece:
        m = safe.search(text, at + piece, at + 2 * piece)
        if m is None:
            m = safe.search(text, at + piece)
        nxt = m.start() if m else len(text)
        cuts.append(nxt)
        at = nxt
        if at >= len(text):
            break
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return cuts


def leaves(text: str, piece: int) -> list[tuple[str, bool]]:
    """Parts of text whose encodings put together give that of text, and whether the join with the part before needs mending."""
    out: list[tuple[str, bool]] = []
    cuts = cut_points(text, piece)
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo <= 2 * piece:
            out.append((text[lo:hi], False))
            continue
        held: list[str] = []  # words of the pattern not yet in a leaf
        for m in regex.finditer(PATTERN, text[lo:hi]):
            word = m.group()
            if len(word) > piece:
                out += flushed(held)
                out += [(part, k > 0) for k, part in enumerate(halves(word, piece))]
                held = []
            else:
                held.append(word)
                if len(held) >= piece and not word.isspace():
                    out += flushed(held)
                    held = []
        out += flushed(held)
    return out


def flushed(words: list[str]) -> list[tuple[str, bool]]:
    """Leaves for whole words of the pattern. White space before a word can be two words of the pattern that would be one
    at the end of a text, so a last word of white space gets its own leaf."""
    if len(words) > 1 and words[-1].isspace():
        return [("".join(words[:-1]), False), (words[-1], False)]
    return [("".join(words), False)] if words else []


def halves(word: str, piece: int) -> list[str]:
    """One overlong word in halves of halves, no part longer than piece."""
    if len(word) <= piece:
        return [word]
    mid = len(word) // 2
    return halves(word[:mid], piece) + halves(word[mid:], piece)


def mend(enc, left: np.ndarray, right: np.ndarray, window: int = 8) -> np.ndarray:
    """Encoding of one word from those of its two parts.

    The bytes of the last and first ``window`` ids around the join are encoded again. The result stands if it begins
    with the id that opens the window on the left and ends with the one that closes it on the right: then each pair of
    neighbouring ids occurs in a true encoding, which makes the whole a true encoding. Else the window doubles, at
    last to both parts as a whole. A window that would begin or end inside a character grows to the character's edge.
    """
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        raw = enc.decode_bytes(left[a:].tolist()) + enc.decode_bytes(right[:b].tolist())
        whole = a == 0 and b == len(right)
        try:
            ids = enc._encode_single_piece(raw) if hasattr(enc, "_encode_single_piece") else enc._core_bpe.encode_single_piece(raw)
        except Exception:  # the window cuts a character: a wider one is tried
            if whole:
                raise
            window *= 2
            continue
        if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]) and (whole or len(ids) > 1):
            return np.concatenate([left[:a], np.array(ids, left.dtype), right[b:]])
        window *= 2


def concat(enc, parts: list[np.ndarray], joins: list[bool]) -> np.ndarray:
    """Put the encodings of leaves together: plain where the join is clean, as a balanced tree within a mended word."""
    words: list[list[np.ndarray]] = []
    for p, j in zip(parts, joins):
        if j:
            words[-1].append(p)
        else:
            words.append([p])
    out = []
    for w in words:
        while len(w) > 1:
            w = [mend(enc, w[i], w[i + 1]) if i + 1 < len(w) else w[i] for i in range(0, len(w), 2)]
        out.append(w[0])
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def lists(ids: list) -> pa.Array:
    """Arrow list array of the id lists."""
    offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode_corpus(docs: DataFrame, path: str | None = None, piece: int = PIECE) -> DataFrame:
    """id and ids (array of int) of each row of docs (id long, text string), without special tokens.

    An empty and a null text give an empty list; blank texts are encoded as they are; a repeated row comes out as often
    as it is there; columns other than id and text are ignored. Texts of at most ``2 * piece`` characters are encoded
    where they are read, with no shuffle. Longer ones are cut into leaves that are encoded in parallel in other tasks and
    put together again by document, the ids of a document being one value of the result in any case.
    """
    spark = ship(docs.sparkSession)
    file = sent_file(spark, path or f"{TOKENIZERS}/{BYTE_BPE}")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent_encoder(file)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), lists(ids)], names=["id", "ids"])

    rows = docs.select(F.col("id").cast("long").alias("id"), "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > 2 * piece
    done = spread(rows.where(~is_long)).mapInArrow(short, "id long, ids array<int>")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, row, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                parts = leaves(text, piece)
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"id": [key] * n, "row": [row] * n, "pos": list(range(n)), "mended": [m for _, m in parts], "part": [t for t, _ in parts]}, pa.schema([("id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("mended", pa.bool_()), ("part", pa.string())]))

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent_encoder(file)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "row", "pos", "mended")), lists(ids)], names=["id", "row", "pos", "mended", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent_encoder(file)
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                out.append(concat(enc, [np.array(p["ids"], np.int32) for p in parts], [p["mended"] for p in parts]))
            yield pa.RecordBatch.from_arrays([b.column("id"), lists(out)], names=["id", "ids"])

    pieces = (
        rows.where(is_long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("id", "row", "text")
        .mapInArrow(split, "id long, row long, pos int, mended boolean, part string")
        .repartition("id", "row", "pos")
        .mapInArrow(encode_parts, "id long, row long, pos int, mended boolean, ids array<int>")
    )
    long = pieces.groupBy("id", "row").agg(F.sort_array(F.collect_list(F.struct("pos", "mended", "ids"))).alias("parts")).select("id", "parts").mapInArrow(join, "id long, ids array<int>")
    return done.unionByName(long)
