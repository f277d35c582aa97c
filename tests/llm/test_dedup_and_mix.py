import hashlib

import pytest

from pagelattice.llm import digest_dedup as dd
from pagelattice.llm import source_mix as sm

SCHEMA = "doc_id long, text string, source string, lang string, digest string, _size long"


def rows(spark, data):
    return spark.createDataFrame([(*r, None, "clash", 7) for r in data], SCHEMA)


def test_dedup_by_brute_force(spark):
    data = [(1, "a b", "x"), (2, "ab", "x"), (3, "a  b", None), (4, None, "x"), (5, "", "x"), (6, " \t", "x"), (7, "é", "x"), (8, "é", "x"), (9, "a b", "x"), (3, "a  b", None), (None, "z", "x")]
    out = dd.dedup(rows(spark, data), dd.new_index(spark, 4)).collect()
    assert len(out) == len(data)
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for r in out:
        text = next(t for i, t, _ in data if i == r.doc_id)
        same = [(i, t or "") for i, t, _ in data if strip(t) == strip(text)]
        assert r.text_sha256 == hashlib.sha256(strip(text).encode()).hexdigest()
        assert r.group_size == len(same)
        assert r.keep_id == min(same, key=lambda x: (-len(x[1]), x[0] if x[0] is not None else 1e99))[0]
    kept = [r.doc_id for r in out if r.kept]
    assert sorted(k for k in kept if k) == [3, 6, 7, 8, 9] and None in kept


def test_index_takes_up_only_what_is_new(spark):
    index = dd.new_index(spark, 4)
    dd.dedup(rows(spark, [(1, "a", "x"), (2, "b", "x")]), index).collect()
    out = {r.doc_id: r for r in dd.dedup(rows(spark, [(3, "a ", "x"), (4, "c", "x"), (5, "c", "x")]), index).collect()}
    assert (out[3].kept, out[3].keep_id, out[3].group_size) == (False, 1, 2)
    assert out[4].kept and not out[5].kept
    assert index.rows().count() == 3
    again = dd.DigestIndex(spark, index.path, 4)
    assert [r.doc_id for r in dd.survivors(rows(spark, [(6, "b", "x"), (7, "d", "x"), (8, "d", "x")]), again).collect()] == [7]


def test_dedup_of_nothing(spark):
    assert dd.dedup(rows(spark, []), dd.new_index(spark, 4)).count() == 0


def water(sizes):
    """Targets by the rule as told: share by weight, stop at the cap, share the excess again until none is above."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[k] for k in full)
        open_ = [k for k in names if k not in full]
        t = {k: rest * weight[k] / sum(weight[j] for j in open_) for k in open_}
        above = [k for k in open_ if t[k] > 2 * sizes[k]]
        if not above:
            return t | {k: 2.0 * sizes[k] for k in full}
        full |= set(above)


def test_mix_targets_and_copies(spark):
    data = [(i, "w " * (i % 17 + 1), ("a", "b", "B", "é", None)[i % 5] if i % 3 else "hot") for i in range(3000)] + [(9000, None, "empty"), (9001, "", "empty")]
    out = sm.mix(rows(spark, data)).collect()
    sizes = {}
    for i, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = water(sizes), {}
    of = {i: s for i, _, s in data}
    for r in out:
        assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == sizes[of[r.doc_id]]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= 0.03 * n + 20
    assert sorted(out) == sorted(sm.mix(rows(spark, data)).collect())
    mixed = sm.repeated(rows(spark, data))
    assert mixed.columns == rows(spark, []).columns
    assert {(r.doc_id, r["count"]) for r in mixed.groupBy("doc_id").count().collect()} == {(r.doc_id, r.taken // r.size) for r in out if r.taken}


def test_mix_of_nothing(spark):
    assert sm.mix(rows(spark, [])).count() == 0
    assert [r.taken for r in sm.mix(rows(spark, [(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_counts_over_many_batches(spark):
    index = dd.new_index(spark, 4)
    for k in range(1, 5):
        (r,) = dd.dedup(rows(spark, [(k, "a" + " " * k, "x")]), index).collect()
        assert (r.keep_id, r.group_size, r.kept) == (1, k, k == 1)
    assert spark.table(index.name).count() == 4


def test_batches_give_what_one_does(spark):
    data = [(i % 37 if i % 11 else None, "ab "[i % 3] * (i % 5) + " " * (i % 7), "x") for i in range(200)]
    one = dd.dedup(rows(spark, data), dd.new_index(spark, 4)).collect()
    out = dd.dedup_in_batches(rows(spark, data), dd.new_index(spark, 4), 3).collect()
    key = lambda r: (str(r.doc_id), r.keep_id, r.group_size, r.text_sha256)
    assert sorted(map(key, one)) == sorted(map(key, out))
    assert sum(r.kept for r in one) == sum(r.kept for r in out) == len({r.text_sha256 for r in out})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_names_of_the_caller_stay(spark):
    names = ["row", "own", "_row", "digest", "best", "n", "target", "rate", "seed", "source_size", "_size", "_hash", "_key", "_copies", "_own", "taken"]
    data = [(i, f"word {i % 4}", "s", *range(len(names))) for i in range(8)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for out in (dd.survivors(df, dd.new_index(spark, 4)), sm.repeated(df)):
        assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}
    assert dd.survivors(df, dd.new_index(spark, 4)).count() == 4


def test_rows_without_id_draw_by_text(spark):
    data = [(None, f"w {i}", "a") for i in range(400)] + [(i, "w w", "b") for i in range(400)]
    out = sm.mix(rows(spark, data)).collect()
    taken, target = sum(r.taken for r in out if r.doc_id is None), next(r.target for r in out if r.doc_id is None)
    assert abs(taken - target) <= 0.05 * target


def test_a_very_long_text(spark):
    data = [(1, "ab " * 400_000, "a"), (2, "ab" * 400_000, "a"), (3, "x", "a")]
    out = {r.doc_id: r for r in dd.dedup(rows(spark, data), dd.new_index(spark, 4)).collect()}
    assert (out[2].keep_id, out[2].group_size, out[1].kept) == (1, 2, True)
    assert {r.doc_id: r["size"] for r in sm.mix(rows(spark, data)).collect()} == {1: 400_000, 2: 1, 3: 1}
