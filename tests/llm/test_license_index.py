import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import license_index as li

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, x) for p, x in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


CASES = [None, "", " ", "MIT License", "the mit-license, MIT LICENSE!", "mit\nlicense mit license", "mit licenses", "éMIT license", "GNU General Public License, version 3", "general public general public license", "apache (license) 2.0; apache license", "mit apache license", "license mit", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "mit license " * 5000, "K license", "public license"]


def test_base_columns_by_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(CASES)] + [(3, CASES[3], "x", None), (None, None, None, None)], "doc_id long, text string, label string, n_words int")
    out = li.scan(df).collect()
    assert len(out) == len(CASES) + 2
    for r in out:
        text = CASES[r.doc_id] if r.doc_id is not None else None
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in out}
    assert labels[13] == "cc-by-nc" and "apache-notice" in labels[14]
    assert li.scan(df.limit(0)).count() == 0
    assert {(r.label, r.start_word, r.end_word) for r in li.places(df).where("doc_id = 4").collect()} == {("mit", 1, 3), ("mit", 3, 5)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["mit", "MIT", "license", "apache", "general", "public", "é", "x", "-", "\n"]), max_size=30), st.sampled_from([" ", "-", ""]))
def test_any_words(parts, sep):
    index = li.PositionalIndex(10, {b"mit": 9, b"license": 1, b"public": 3})
    assert index.verdict(sep.join(parts))[:5] == brute(sep.join(parts))


def every_place(index, found):
    """All places by trying each template at each start."""
    out = []
    for k, (t, seq) in enumerate(zip(index.templates, index.seq, strict=True)):
        rare = sorted(set(seq), key=lambda w: (-index.idf[w], w))[: li.VOTERS + len(seq) // li.VOTER_STEP]
        key = li.words(t.key)
        for start in range(-len(seq), len(found)):
            there = [j for j in range(len(seq)) if 0 <= start + j < len(found) and found[start + j] == seq[j]]
            agree = {seq[j] for j in there if seq[j] in rare}
            at = next(i for i in range(len(seq)) if seq[i : i + len(key)] == key)
            share = sum(index.idf[seq[j]] for j in there) / sum(index.idf[w] for w in seq)
            if len(agree) >= min(li.AGREE, len(rare)) and set(range(at, at + len(key))) <= set(there) and share >= li.SHARE:
                out.append((k, start, min(1.0, share)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(range(len(li.TEMPLATES))), min_size=1, max_size=3), st.lists(st.tuples(st.floats(0, 1), st.sampled_from(["drop", "swap", "twice"])), max_size=6), st.booleans())
def test_all_labels_and_scores_by_brute_force(picks, edits, rare_mit):
    found = [w for k in picks for w in li.words(li.TEMPLATES[k].words)]
    for at, kind in edits:
        i = int(at * (len(found) - 1)) if found else 0
        found[i : i + 1] = {"drop": [], "swap": [b"other"], "twice": found[i : i + 1] * 2}[kind]
    index = li.PositionalIndex(50, {b"mit": 2 if rare_mit else 40, b"license": 30, b"the": 45, b"software": 9})
    want = every_place(index, found)
    got = index.scan(found)
    assert sorted((k, s) for k, s, _ in got) == sorted((k, s) for k, s, _ in want)
    n, _, _, _, _, labels, score = index.verdict(b" ".join(found).decode())
    assert n == len(found) and labels == ",".join(sorted({li.TEMPLATES[k].label for k, _, _ in want}))
    assert abs(score - max((x for _, _, x in want), default=0.0)) < 1e-9


def test_whole_texts_of_licences():
    index = li.PositionalIndex(0, {})
    for t in li.TEMPLATES:
        assert t.label in index.verdict("Some words before.\n" + t.words + "\nand after")[5].split(",")
