import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelattice.llm import pair_bpe as pb
from pagelattice.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def spans(text):
    """First and last character of each token, by walking through the bytes."""
    char = [k for k, c in enumerate(text) for _ in c.encode()]
    out, at = [], 0
    for i in LIBRARY.encode(text, add_special_tokens=False).ids:
        n = len(pb.codec(PATH).bytes_of[i])
        out.append((char[at], char[at + n - 1]))
        at += n
    assert at == len(char)
    return out


def sentences(text):
    out = []
    for i, c in enumerate(text):
        if i == 0 or text[i - 1] == "\n" or i > 1 and text[i - 1] == " " and text[i - 2] in ".!?":
            out.append(i)
    return [(a, b) for a, b in zip(out, [*out[1:], len(text)], strict=False)]


def brute(text, sections, rule):
    holds = lambda c: next((k for k, (a, b) in enumerate(sections) if a <= c < b), -1)
    counts, outside, crossing = [0] * len(sections), 0, 0
    for a, b in spans(text):
        where = [holds(c) for c in range(a, b + 1)]
        crossing += len(set(where)) > 1
        w = where[0] if rule == "first" else max(sorted(set(where), key=lambda k: (k < 0, k)), key=where.count)
        if w >= 0:
            counts[w] += 1
        else:
            outside += 1
    return len(spans(text)), len(sections), crossing, outside, counts


TEXTS = [None, "", "one", "a\nb\n\n\nc", "\n\n", "é ñ\n漢字🎉\n x", "<|endoftext|>\nz <|endoftext|>", "line\n" * 3000, "  \n  \n", "One. Two! Three? é. ü. 3.5 .  . end.", " starts after. ", " x"]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_tables(spark, rule):
    data = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(None, "a\nb", None, 1), (3, TEXTS[3], "again", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, sections string, n_tokens int").coalesce(1)
    out = tc.attribute(df, PATH, rule).collect()
    assert len(out) == len(data)
    for r in out:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "a\nb") or ""
        assert (r.n_tokens, r.n_sections, r.n_crossing, r.n_outside, r.section_tokens) == brute(text, sentences(text), rule)
        assert sum(r.section_tokens) + r.n_outside == r.n_tokens
    assert {r.doc_id: r.n_crossing for r in out}[9] >= 4
    assert tc.attribute(df.limit(0), PATH, rule).count() == 0


@pytest.mark.parametrize("rule", ["first", "most"])
def test_fields(spark, rule):
    text, fields = "title here\nbody éé text and more", [(0, 3), (7, 12), (12, 16), (20, 21), (30, 90)]
    rows = [(1, text, fields), (2, None, fields), (3, text, None), (4, "é" + text, fields[1:3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, f array<struct<start:int,end:int>>").coalesce(1)
    for r in tc.attribute(df, PATH, rule, "f").collect():
        _, t, f = rows[r.doc_id - 1]
        assert (r.n_tokens, r.n_sections, r.n_crossing, r.n_outside, r.section_tokens) == brute(t or "", f or [], rule)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n'abcdest.é1"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_spans(texts):
    first, last, at, chars = tc.spans(pb.codec(PATH), texts)
    for i, t in enumerate(texts):
        own = slice(at[i], at[i + 1])
        assert list(zip((first[own] - chars[i]).tolist(), (last[own] - chars[i]).tolist(), strict=True)) == spans(t)
        assert chars[i + 1] - chars[i] == len(t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n.!é1a"), max_size=20), max_size=4))
def test_sentences(texts):
    want, at = [], 0
    for t in texts:
        want += [at + a for a, _ in sentences(t)]
        at += len(t)
    assert tc.sentences(texts).tolist() == want
