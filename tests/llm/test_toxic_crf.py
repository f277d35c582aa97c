import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import toxic_crf as tc


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-3, 3), max_size=6), max_size=5), st.lists(st.floats(0.1, 3), min_size=4, max_size=4))
def test_marginals_by_enumeration(seqs, trans):
    trans = np.array(trans).reshape(2, 2)
    sizes = np.array([len(s) for s in seqs], np.int64)
    steps = tc.Lockstep(sizes)
    _, _, marg = tc.forward_backward(steps.spread(np.array([x for s in seqs for x in s], float)), trans, steps)
    got = marg[steps.place]
    want = []
    for s in seqs:
        sums, total = np.zeros(len(s)), 0.0
        for path in itertools.product((0, 1), repeat=len(s)):
            w = 1.0
            for t, y in enumerate(path):
                w *= trans[path[t - 1] if t else 0, y] * np.exp(s[t] * y)
            total += w
            sums += w * np.array(path)
        want += (sums / total).tolist()
    assert np.allclose(got, want)


def corpus(n=400):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    bad = ["nasty", "awfuls", "awfully", "awfuling"]
    docs, labels = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        y = int(i % 4 == 0)
        for _ in range(3 * y):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(bad))
        docs.append((i, " ".join(ws), "source", 1.0))
        labels.append((i, y))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    extra = [(1000, None, "s", None), (1001, "", "s", 1.0), (1002, "x " * 30000 + "nasty awfuls", None, 1.0), (None, "nasty", "s", 1.0), (7, docs[7][1], "again", 0.0)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame(labels + [(5000, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = tc.train(df, lab)
    out = tc.tag(df, model).collect()
    assert len(out) == len(docs) + len(extra)
    y = dict(labels)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    seen = [r for r in out if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in seen]) > 0.95
    one = {r.doc_id: r for r in out}
    assert one[1000].score == one[1001].score < 0.5 and one[1002].spans
    s = one[1002].spans[0]
    assert (s.start, s.end) == (60000, 60012)
    assert len({r.score for r in out if r.doc_id == 7}) == 1
    kept = tc.clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.predicted for r in out)
    assert tc.tag(df.limit(0), model).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tc.tag(df, tc.train(df, none)).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r.score for r in tc.tag(df, tc.train(df, one)).collect()] == [1.0]
    many = spark.createDataFrame([(1, "some words"), (2, ""), (3, None), (4, "more of them here")], "doc_id long, text string")
    for labels in (none, one, spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, toxic int")):
        assert all(r.spans == [] for r in tc.tag(many, tc.train(many, labels)).collect())
    assert all(r.spans == [] for r in tc.tag(many, tc.Model(constant=0.02)).collect())


def test_partitioning_changes_nothing(spark):
    docs, labels = corpus(300)
    docs += [(i, f"{t} again", s, x) for i, t, s, x in docs[:40]]  # ids with two texts
    labels += [(i, 1 - y) for i, y in labels[50:60]]  # ids with two labels
    found = set()
    for n, adaptive in ((4, "true"), (32, "false")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        df = spark.createDataFrame(docs[:: 1 if n == 4 else -1], "doc_id long, text string, source string, score double").repartition(n)
        lab = spark.createDataFrame(labels, "doc_id long, toxic int").repartition(n)
        found.add(tuple(sorted((r.doc_id, r.score, tuple(r.spans)) for r in tc.tag(df, tc.train(df, lab)).collect())))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(found) == 1
