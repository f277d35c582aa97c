import math
import random

import numpy as np
from pyspark.sql import functions as F

from pagelattice.llm import vector_codes as vc


def brute(rows, o):
    """Codes, errors and codebooks by the contract, in Python integers. rows: (vec_id, vector, label) that can be coded."""
    cut = lambda v: [tuple(math.floor(o.scale * c) for c in v[p * len(v) // o.parts : (p + 1) * len(v) // o.parts]) for p in range(o.parts)]
    rows = [(i, cut(v), label) for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    books = [[r[1][p] for r in rows[: o.entries]] for p in range(o.parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(o.rounds):
        for p, book in enumerate(books):
            got = [[] for _ in book]
            for r in rows:
                got[best(r[1][p], book)[1]].append(r[1][p])
            books[p] = [tuple(sum(c) // len(g) for c in zip(*g, strict=True)) if g else e for g, e in zip(got, book, strict=True)]
    out = []
    for i, x, label in rows:
        found = [best(y, book) for y, book in zip(x, books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return out, books


def test_by_brute_force(spark):
    rng = random.Random(5)
    o = vc.Options(parts=4, entries=8, rounds=3)
    rows = [(rng.randint(-50, 400), [float(np.float32(rng.gauss(rng.choice((-1, 0, 2)), 0.3))) for _ in range(12)], rng.choice(("a", "b", None))) for _ in range(300)]
    rows += [(5, [0.0] * 12, "a")] * 40 + [(5, [0.25] * 12, "hot")] * 100 + [(None, [0.5] * 12, None)]
    rows += [(1000 + k, [rng.choice((-1.0, 1.0)) / 256 for _ in range(12)], "ties") for k in range(60)]
    bad = [(-99, None, "a"), (-98, [float("nan")] * 12, "a"), (-97, [float("inf")] + [0.0] * 11, "b"), (-96, [None] * 12, "a")]
    odd = [(600, [1.0] * 8, "a"), (601, [], "b"), (602, [1e6] * 12, None), (603, [1.0] * 13, "odd")]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad + odd], "vec_id long, embedding array<float>, label string, code int").repartition(5)
    kept = vc.kept(df, "vec_id", "embedding", F.col("label"))
    books = vc.fit(kept, o)
    want, wanted_books = brute(rows, o)
    assert [list(map(tuple, b.tolist())) for b in books] == wanted_books
    total = {}
    for _, _, e, label in want:
        total[label] = total.get(label, 0) + e
    want = [(*w, total[w[3]]) for w in want] + [(i, None, None, label, total.get(label)) for i, _, label in odd]
    coded = vc.encode(kept, books, o)
    few = vc.with_group_errors(coded, "label").select("vec_id", "code", "error", "label", "label_error").collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, few), key=key) == sorted(want, key=key)
    decoded = {(r.vec_id, tuple(r.vector)) for r in vc.decode(coded.where("code is not null"), books, o).collect()}
    assert decoded == {(w[0], tuple(v for p, b in enumerate(wanted_books) for v in b[int(w[1][2 * p : 2 * p + 2], 16)])) for w in want if w[1]}


def test_many_labels_join(spark, monkeypatch):
    coded = spark.createDataFrame([(k, "00", k, k % 7 if k % 7 else None) for k in range(50)], "vec_id long, code string, error long, label int")
    want = sorted(map(tuple, vc.with_group_errors(coded, "label").collect()), key=str)
    monkeypatch.setattr(vc, "FEW_LABELS", 0)
    assert sorted(map(tuple, vc.with_group_errors(coded, "label").collect()), key=str) == want


def test_empty_and_short(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    rows = vc.kept(df, "vec_id", "embedding", F.col("label"))
    assert vc.fit(rows) == [] and vc.encode(rows, []).count() == 0 and len(vc.fingerprint([])) == 64
    one = vc.kept(spark.createDataFrame([(3, [0.5] * 16, None)], "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", F.col("label"))
    books = vc.fit(one)
    assert [b.tolist() for b in books] == [[[128]]] * 16 and vc.encode(one, books).select("code", "error").collect() == [("00" * 16, 0)]


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    for width in (1, 2, 3, 4, 7, 8, 16):
        for size in (3, 300, 1 << 24):
            x, book = rng.integers(-size, size, (500, width)), rng.integers(-size, size, (64, width))
            book[40] = book[3]
            x[:64] = book + rng.integers(-1, 2, book.shape)
            all_d = ((x[:, None] - book[None]) ** 2).sum(-1)
            spent = []
            at, d = vc.nearest(x, book, spent)
            assert (at == all_d.argmin(1)).all() and (d == all_d.min(1)).all()
            assert all(a >= b for a, b in zip(spent[0], spent[0][1:], strict=False))
            for level in vc.levels(width):
                assert (vc.bound(vc.profile(x, level), vc.profile(book, level), np.arange(500)[:, None], np.arange(64)[None]) <= all_d).all()
