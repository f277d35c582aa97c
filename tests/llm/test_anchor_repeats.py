import hashlib
import random
from collections import Counter

import numpy as np

from pagelattice.llm import anchor_repeats as ar
from pagelattice.llm import hashing as hs


def brute(rows):
    """By the contract, over (doc_id, text) rows."""
    split = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for (k, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmno")
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 50, 53, 70, 200)]
    rows = []
    for i in range(150):
        w = text(rng.randint(0, 120))
        for s in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            a = rng.randint(0, 3)
            w[at:at] = s[a : len(s) - rng.randint(0, 3)]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    long = text(3000)
    rows += [(200, " ".join(long + long[100:140] + long[500:534])), (201, None), (202, ""), (203, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (-1, rows[9][1]), (204, "x " * 100), (205, "y " * 35), (206, "y " * 36), (207, " a " * 40)]
    return rows


def test_by_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", b"1") for r in rows], "doc_id long, text string, k1 string, at binary").repartition(6)
    order = lambda x: sorted(map(tuple, x), key=str)
    assert order(ar.digests(df).collect()) == order(brute(rows))
    full = {r.doc_id: r for r in ar.without_repeats(df).collect()}
    for k, n, gone, sha in brute(rows):
        if k not in (7, None, -1):
            assert hashlib.sha256(full[k].text.encode()).hexdigest() == sha and sum(s.words for s in full[k].spans) == gone
    assert ar.digests(df.limit(0)).count() == 0


def test_packing_and_windows():
    for x in ([], [5], [1, 2, 2**40, 2**63], list(range(0, 10**6, 7))):
        x = np.array(x, np.uint64)
        assert (hs.unpack_sorted(hs.pack_sorted(x)) == x).all()
    h = np.arange(100, dtype=np.uint64)
    for n in (1, 2, 3, 18, 35):
        for k in (0, 1):
            w = hs.windows(np.concatenate((h, h)), n, k)
            assert len(w) == 201 - n and (w[: 101 - n] == w[100:]).all() and len(np.unique(w[:100])) == 100
