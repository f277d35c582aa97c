import hashlib
import random

import numpy as np
import pyarrow as pa

from pagelattice.llm import hashing as hs
from pagelattice.llm import prefix_doubling as pd


def brute(rows):
    """By the contract, over (doc_id, text) rows."""
    texts = [(t or "").encode() for _, t in rows]
    least = {}
    for (k, _), t in zip(rows, texts, strict=True):
        if k is not None:
            for i in range(len(t) - 49):
                s = t[i : i + 50]
                least[s] = min(k, least.get(s, k))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 49) if k is not None else ():
            if least[t[i : i + 50]] < k:
                gone[i + 1 : i + 51] = True
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(n) for n in (45, 48, 49, 50, 51, 60, 75, 90, 120, 400)] + ["x" * 70, "ab" * 60]
    rows = []
    for _ in range(160):
        t = text(rng.randint(0, 150))
        for s in rng.sample(shared, rng.randint(0, 3)):
            at, a = rng.randint(0, len(t)), rng.randint(0, 3)
            t = t[:at] + s[a : len(s) - rng.randint(0, 3)] + t[at:]
        rows.append((rng.randint(-1000, 1000), t))
    long = text(2500)
    near = [(3000 + i, long[: 80 * i] + rng.choice("xyz") + long[80 * i + 1 :]) for i in range(25)]
    rows += near + [(5000, long + long), (5001, None), (5002, ""), (5003, rows[7][1]), (rows[7][0], rows[7][1]), (rows[8][0], rows[7][1]), (None, rows[9][1]), (None, long), (-2000, "z" * 300), (6000, "z" * 120 + "q" + "z" * 49), (6001, "a" * 49), (6002, "日本語" * 30), (6003, "本語日" * 30)]
    rng.shuffle(rows)
    return rows


def by_key(x):
    return sorted(map(tuple, x), key=str)


def test_by_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, b"clash", 1, 2) for r in rows], "doc_id long, text string, gone binary, part int, k1 int").repartition(6)
    want = brute(rows)
    assert by_key(pd.digests(df).collect()) == by_key(want)
    full = pd.without_repeats(df).collect()
    assert by_key((r.doc_id, sum(s.bytes for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in full) == by_key((k, g, s, h) for k, _, g, s, h in want)
    assert pd.digests(df.limit(0)).count() == 0
    # without doublings, ranks settle nothing and the strings themselves decide
    monkeypatch.setattr(pd, "ROUNDS", 0)
    monkeypatch.setattr(pd, "SLICE", 4000)
    assert by_key(pd.digests(df).collect()) == by_key(want)


def test_nothing_shared(spark):
    df = spark.createDataFrame([(i, hashlib.sha512(str(i).encode()).hexdigest()) for i in range(50)] + [(99, None)], "doc_id long, text string")
    assert {(r.n_removed, r.n_spans) for r in pd.digests(df).collect()} == {(0, 0)}


def test_rounds_settle_what_lies_within(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    left = []
    keep = pd._left

    def seen(batches):
        for b in keep(batches):
            yield b

    df = spark.createDataFrame([(i, long[:10_000] + f"#{i}#" + long[10_000:]) for i in range(6)], "doc_id long, text string").repartition(3)
    texts = pd.keyed(df)
    state = pd._round(texts.mapInArrow(pd._first(8), pd._ROW_SQL), 8, pd._ranked_first, pd._STATE_SQL, "t")
    for k in range(pd.ROUNDS):
        state = pd._round(state.mapInArrow(pd._doubled(8), pd._ROW_SQL), 8, pd._ranked, pd._STATE_SQL, f"t{k}")
    left = state.mapInArrow(seen, pd._DOC_SQL).collect()
    assert len(left) == 6
    for r in left:
        a, b = pd._unpack(r.open)
        assert (b - a).sum() < 600  # near both ends of the text, and around the digit
        c, d = pd._unpack(r.gone)
        assert (d - c).sum() == 0 if r.k1 == 0 else (d - c).sum() > 18_000


def test_positions():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (0, 10, 49, 50, 51, 75, 300, 1000, 26)] + [b"a" * 200, b"ab" * 100]
    data, at = hs.flat(pa.array(texts))
    place, h = pd.positions(data, at)
    every = hs.windows(pd._BYTES[data], pd.GRAM)
    want = {min((int(every[at[i] + p + k]) >> 20, int(at[i]) + p + k) for k in range(pd.CHOICES))[1] for i, t in enumerate(texts) for p in range(len(t) - 49)}
    assert sorted(want) == place.tolist() and (every[place] == h).all()
    for x in ([], [5], [-7, 3, 2**62, -(2**62)], [0, 0], list(range(300))):
        assert hs.unpack_ints(hs.pack_ints(np.array(x, np.int64))).tolist() == x
    for x in ([], [4], [4, 4, 4], [0, 0, 2**40]):
        assert hs.unpack_sorted(hs.pack_sorted(np.array(x, np.uint64))).tolist() == x


def test_cover():
    rng = np.random.default_rng(0)
    for _ in range(200):
        plus, minus = ((a := rng.integers(0, 40, rng.integers(0, 8)), a + rng.integers(1, 9, len(a))) for _ in range(2))
        marks = np.zeros(60, int)
        for a, b in zip(*plus, strict=True):
            marks[a:b] = 1
        for a, b in zip(*minus, strict=True):
            marks[a:b] = 0
        a, b = pd.cover(plus, minus)
        again = np.zeros(60, int)
        for x, y in zip(a, b, strict=True):
            again[x:y] += 1
        assert (again == marks).all() and (a[1:] > b[:-1]).all()
