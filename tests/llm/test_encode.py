from __future__ import annotations

import random

import numpy as np
import pytest

from fiscalspark.llm import encode

ENC = encode.encoder(f"{encode.TOKENIZERS}/{encode.BYTE_BPE}")


def by_parts(text: str, piece: int) -> list[int]:
    parts = encode.leaves(text, piece)
    assert "".join(t for t, _ in parts) == text
    return encode.concat(ENC, [np.array(ENC.encode_ordinary(t), np.int32) for t, _ in parts], [m for _, m in parts]).tolist()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "áéñçàö", "0123456789", "-=_*.", " ", " \n\t", "aá1-' \n", "漢字かな", "🙂🏽é"])
def test_leaves_and_mending_equal_the_direct_encoding(alphabet):
    rnd = random.Random(alphabet)
    for n in (1, 7, 40, 300, 1500):
        for piece in (1, 3, 16, 64):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            assert by_parts(text, piece) == ENC.encode_ordinary(text)


def test_natural_words_run_together():
    rnd = random.Random(5)
    words = "the administration resolución subvenciones contratación Ministerio of and encinares viaductos".split()
    for _ in range(20):
        text = "".join(rnd.choice(words) for _ in range(200))
        assert by_parts(text, 16) == ENC.encode_ordinary(text)


def test_corpus_with_nulls_blanks_repeats_and_long_texts(spark):
    texts = [None, "", "  ", "hola mundo", "hola mundo", "x" * 500, "palabra " * 90, "1" * 333 + " fin", "<|endoftext|>", "a\r\nb"]
    rows = [(i // 2, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, row string")
    got = sorted((r.id, list(r.ids)) for r in encode.encode_corpus(df, piece=32).collect())
    assert got == sorted((i // 2, ENC.encode_ordinary(t) if t else []) for i, t in enumerate(texts))


def test_same_ids_as_the_other_library_and_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ["Resolución de 3 de mayo: 1.234,56 €", "  dos  blancos \n\n", "it's they've Ünïcødé 🙂", "<|endoftext|>"]:
        ids = ENC.encode_ordinary(text)
        assert ids == t.encode(text, add_special_tokens=False).ids
        assert ENC.decode(ids) == text


def test_empty_table(spark):
    assert encode.encode_corpus(spark.createDataFrame([], "id long, text string")).collect() == []


def test_texts_beyond_the_real_limit(spark):
    """One long text with blanks, and one word longer than two pieces, each in more than one part at the size that production uses."""
    rnd = random.Random(9)
    word = "".join(rnd.choice("abcdefghijklmnop") for _ in range(2 * encode.PIECE + 5000))
    text = " ".join("".join(rnd.choice("aeiourst") for _ in range(rnd.randrange(1, 9))) for _ in range(60_000))
    assert len(word) > 2 * encode.PIECE < len(text) and len(encode.leaves(word, encode.PIECE)) > 1 < len(encode.leaves(text, encode.PIECE)) and any(m for _, m in encode.leaves(word, encode.PIECE))
    df = spark.createDataFrame([(1, word), (2, text), (3, "corto")], "id long, text string")
    got = {r.id: list(r.ids) for r in encode.encode_corpus(df).collect()}
    assert got == {1: ENC.encode_ordinary(word), 2: ENC.encode_ordinary(text), 3: ENC.encode_ordinary("corto")}
