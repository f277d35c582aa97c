import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelattice.llm import pair_bpe as pb

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  ", "a \n\n b", "\n \n", "don't we'll I'VE 's", "aaaaaaa aaaa", "é ñ ß 漢字 🎉🎉 ไทย", "a<|endoftext|> b  <|endoftext|>", "x\x1cy\x85z\u00a0w\u3000v", "12 345,67.8", "abab" * 300, "\t\tif x:\n\t\t\treturn 1", "e\u0301 \u0345", "\x00\x01"]


def same(texts):
    for t, (ids, text) in zip(texts, pb.codec(PATH).encode(texts), strict=True):
        want = LIBRARY.encode(t, add_special_tokens=False).ids
        assert [int(x) for x in ids.split(b",") if x] == want, t
        assert text == LIBRARY.decode(want, skip_special_tokens=False) == pb.codec(PATH).decode(want)


def test_odd_texts():
    same(ODD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'abcdest.,é1"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text(texts):
    same(texts)


def test_tables(spark):
    schema = "doc_id long, text string, ids string, n_tokens int"
    data = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, None, None, None), (3, "again", None, 1), (3, "again", None, 1)]
    df = spark.createDataFrame(data, schema)
    out = pb.digests(df, PATH).collect()
    assert len(out) == len(data)
    for r in out:
        texts = [t or "" for i, t, *_ in data if i == r.doc_id]
        want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        assert (r.n_tokens, r.ids_sha256) in [(len(w), hashlib.sha256(",".join(map(str, w)).encode()).hexdigest()) for w in want]
        assert r.decoded_sha256 in [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    back = pb.decoded(pb.encoded(df, PATH), PATH).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in back) == sorted(((i or -1) if i != 0 else -1, t or "") for i, t, *_ in data)
    assert pb.digests(df.limit(0), PATH).count() == 0


def test_a_slice_takes_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from pagelattice.llm import common

    words = [f"wörd{i} " for i in range(3000)]
    texts = ["".join(words[(i * 7 + k * k) % 3000] for k in range(1000)) for i in range(1000)]  # some 9 MB
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    codec = pb.codec(PATH)
    codec.slice(texts[:10])
    tracemalloc.start()
    n = sum(len(codec.slice(s.column("text")).ids) for s in common.slices(iter([batch]), "text", pb.SLICE))
    peak = tracemalloc.get_traced_memory()[1] >> 20
    tracemalloc.stop()
    assert n > 1_000_000 and peak < 100, peak
