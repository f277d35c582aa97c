import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelattice.llm import range_coder as rc
from pagelattice.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "<|ENDOFTEXT|> Q", "(a)b.c,D;e-f ..x9?!\u0301z", "Hello  WORLD's 123", "é é ́x ΑΣ Σ ΌΣΟΣ.", "a b　c\x1cd\x85e", "x<|endoftext|>y <|startoftext|>", "漢字 🎉 İstanbul ẞ", "a\r\nb\tc\x0bd"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0, 1, 63, 65, 4096, 4097, 9001]), st.sampled_from([1, 3, 500, 65535]))
def test_coder_round_trip(seed, n, spread):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, spread, n)
    if n > 10:
        ids[n // 2 :] = ids[: n - n // 2]
    data = rc.pack([1, None], np.array([n, 0]), ids)
    docs, sizes, back = rc.unpack(data)
    assert docs == [1, None] and sizes.tolist() == [n, 0] and (back == ids).all()
    if n > 4096:
        assert (rc.read_block(data, 1) == ids[4096:8192]).all()


def test_damage_is_found():
    data = rc.pack([1], np.array([9000]), np.arange(9000) % 777)
    for at in (3, 8, 40, len(data) // 2, len(data) - 900):
        with pytest.raises(rc.BadFile):
            rc.unpack(data[:at] + bytes([data[at] ^ 5]) + data[at + 1 :])
    with pytest.raises(ValueError):
        rc.encode(np.array([65535]))


def test_repetition_is_cheap():
    assert len(rc.pack([1], np.array([4096]), np.tile(np.arange(50), 82)[:4096])) < 1500


@settings(max_examples=100, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'sS.,é1Σ́"), st.characters(exclude_categories=["Cs"])), max_size=50))
def test_words_as_the_library_has_them(text):
    assert tf.encoder(PATH).encode([text])[1].tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


def test_files(spark):
    data = [(i * 7 % 101, ODD[i % len(ODD)] + " more" * (i % 50), "clash", 1) for i in range(101)] + [(5, None, None, None), (5, None, None, None), (None, "no id", "x", 2), (-3, "word " * 20000, "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, part string, seq int").repartition(7)
    want, at = [], 0
    for i, t in sorted(((i, t or "") for i, t, *_ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*LIBRARY.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    segments = tf.write(df, PATH)
    assert sorted(map(tuple, tf.digests(segments).collect()), key=str) == sorted(want, key=str)
    assert [len(r.ids) for r in tf.read(segments).orderBy("start").collect()] == [w[2] for w in want]
    assert tf.digests(tf.write(df.limit(0), PATH)).count() == 0
