import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import components as cc
from pagelattice.llm import set_join as sj


def shingles(t, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=3, num=90):
    sets = [shingles(t, k) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                comp[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, len(s), low.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(n_near=60):
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, k = [], 100
    line = text(12)
    for _ in range(40):
        base = text(rng.choice((1, 2, 3, 5, 12, 40, 90, 300)))
        for _ in range(rng.choice((1, 1, 2, 5))):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(w).upper() if rng.random() < 0.2 else "\n".join(w)))
            k += 1
    base = text(120)
    for _ in range(n_near):  # a large group of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w + (line if rng.random() < 0.1 else []))))
        k += 1
    for _ in range(30):
        rows.append((k, " ".join(line + text(15))))
        k += 1
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "b a"), (None, "A  B"), (8, "a b c"), (9, "a b c a b c a b c"), (8, "a b c"), (10, "é é é"), (11, "É É É")]


def test_by_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, d string, n int").repartition(5)
    assert sorted(map(tuple, sj.join(df).collect()), key=str) == brute(rows)
    assert sj.join(df.limit(0)).count() == 0


def test_survivors(spark):
    rows = [r for r in corpus() if r[0] not in (8, None)] + [(8, "a b c"), (8, "a b c")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, _k1 string, k2 int").repartition(3)
    out = sj.survivors(df)
    assert out.columns == df.columns and {(r._k1, r.k2) for r in out.collect()} == {("clash", 1)}
    want = {c for k, n, c in brute(rows, 5, 80) if n} | {k for k, n, _ in brute(rows, 5, 80) if not n}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_pairs_of_a_large_group_are_not_written(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(400):  # even ones differ from each other by at most 12 shingles, which links them, and from odd ones by 14, which doesn't
        w = list(base)
        w[3 + 3 * (k % 38)] = f"x{k}"
        if k % 2:
            w[-1] = f"y{k}"
        rows.append((k, " ".join(w)))
    written, staged = [], sj.common.staged

    def counting(df, name, by=None):
        out = staged(df, name, by)
        if {"x", "y"} <= set(out.columns):
            written.append(out.count())
        return out

    monkeypatch.setattr(sj.common, "staged", counting)
    monkeypatch.setattr(sj, "ROUNDS", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sj.join(df).collect()), key=str)
    assert got == brute(rows) and sum(k == 0 for _, _, k in got) == 200
    assert sum(written) <= sj.Rule().prefix(118) * len(rows)  # entries of the lists; there are some 40,000 pairs of unlinked ones


def test_clusters_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sj, "CHUNK_BYTES", 5000)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, sj.join(df).collect()), key=str) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 30), min_size=1), st.integers(0, 3), st.integers(0, 1)), min_size=1, max_size=25), st.booleans())
def test_links_of_a_cluster(entries, across):
    rule = sj.Rule(5, 80)
    entries = sorted(entries, key=lambda e: len(e[0]))
    sets = [np.array(sorted(e[0]), np.uint64) for e in entries]
    c, chunk = (np.array([e[k] for e in entries], np.int64) for k in (1, 2))
    dist = np.array([len(e[0] ^ entries[0][0]) for e in entries], np.int64)
    got = sj.Cluster(rule, sets, c, np.zeros(len(c), np.int64), dist, chunk, across).links()
    linked = lambda x, y: 100 * len(entries[x][0] & entries[y][0]) >= 80 * len(entries[x][0] | entries[y][0])
    every = [(x, y) for y in range(len(c)) for x in range(y) if linked(x, y) and not (across and chunk[x] == chunk[y])]
    a, b = sj.Forest(4), sj.Forest(4)
    assert all(a.join(c[x], c[y]) for x, y in got) and set(got) <= set(every)
    for x, y in every:
        b.join(c[x], c[y])
    assert a.roots().tolist() == b.roots().tolist()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    want = {}
    for a, b in edges:
        x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
        if x is not y:
            x |= y
            for z in y:
                want[z] = x
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {k: min(v) for k, v in want.items() if len(v) > 1}


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400)), st.sets(st.integers(0, 400)))
def test_bounds(a, b):
    pack = lambda s: np.array(sorted(s), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if a and b:
        rule = sj.Rule()
        maps = sj.Bitmaps([sj.bitmap(pack(x), rule.bits(len(x))) for x in (a, b)])
        assert maps.distance(np.array([0, 1]), np.array([1, 1])).tolist() == [maps.distance(np.array([1]), np.array([0]))[0], 0]
        assert maps.distance(np.array([0]), np.array([1]))[0] <= len(a ^ b)
        linked = 100 * len(a & b) >= 90 * len(a | b)
        assert linked == (len(a & b) >= rule.overlap(len(a) + len(b)))
        if linked:
            order = sorted(a | b)
            assert set([x for x in order if x in a][: rule.prefix(len(a))]) & set([x for x in order if x in b][: rule.prefix(len(b))])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 60), st.integers(0, 3), st.integers(0, 7)), max_size=40))
def test_blocks_leave_out_nothing(entries):
    rule = sj.Rule()
    o, n, c, pos = np.array([(o, n, c, min(p, n - 1)) for o, n, c, p in entries], np.int64).reshape(-1, 4).T
    blocks = sj.Blocks(rule, o, n, c, pos)
    got = [tuple(sorted(map(int, blocks.order[[a, b]]))) for i, j in blocks.pairs(16) for a, b in zip(i, j, strict=True)]
    want = [(i, j) for i in range(len(o)) for j in range(i + 1, len(o)) if o[i] == o[j] and sj._allowed(rule, n[i], pos[i], n[j], pos[j], c[i], c[j])]
    assert sorted(got) == want


def test_blocks_are_skipped():
    n = np.repeat([100, 105, 150], 50)
    pos = np.tile(np.arange(50) % 12, 3)
    blocks = sj.Blocks(sj.Rule(), np.zeros(150, np.int64), n, np.arange(150) // 50 % 2, pos)
    found = sum(len(i) for i, _ in blocks.pairs())
    assert 0 < found < 50 * 50 and blocks.skipped > 0 and blocks.cut > 0


def test_tables_are_deleted(spark):
    from pathlib import Path

    from pagelattice.llm import common

    root = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(root.iterdir())
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    sj.join(df).count()
    left = {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before}
    assert left <= {"sets", "set-lists", "labels", "cc-labels", "set-result", "set-judged", "set-counted"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), unique=True, max_size=20), st.lists(st.integers(0, 50), unique=True, max_size=20))
def test_least_before_tells_of_an_earlier_meeting(a, b):
    a, b = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
    la, lb = sj._least_before(a), sj._least_before(b)
    for i in range(1, len(a)):
        for j in range(1, len(b)):
            if la[i] == lb[j]:
                assert set(a[:i].tolist()) & set(b[:j].tolist())
