import hashlib
import re

from pagelattice.llm import fill_middle as fm


def brute(doc_id, text):
    """n, form, output, prefix and middle characters by the contract."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    parts = ["".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:])]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}", len(parts[0]), len(parts[1])
    return n, "psm", f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}", len(parts[0]), len(parts[1])


def corpus():
    odd = [None, "", " ", "<P>", "a<M>b", "a<S", "<", "<<P", "P>x", "naïve 😀 日本\n\tx", "'quoted' \"x\" \\ %_", "one", "a" * 5000, "1" * 5000, "nul\0in it", "é combining", "\r\n\r\n"]
    rows = [(i, odd[i % len(odd)]) for i in range(12 * len(odd))]
    rows += [(i, f"def f{i}(x):\n    return x + {i} # <{i % 7}S" * (i % 5)) for i in range(1000, 1400)]
    return [*rows, (None, "no id here"), (-3, "negative ids"), (7, rows[7][1]), (2**62, "long " * 60_000)]


def test_by_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, form string, tokens int").repartition(5)
    key = lambda r: str(tuple(r))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *brute(i, t)) for i, t in rows]
    made = fm.transform(df)
    assert sorted(made.collect(), key=key) == sorted(want, key=key)
    assert {"psm", "spm", "plain"} == {w[2] for w in want}
    back = fm.restore(made)
    assert sorted(back.collect(), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    got = fm.digests(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(got, key=key) == sorted(((i, n, form, p, m, sha(o), sha(t or "")) for (i, t), (_, n, form, o, p, m) in zip(rows, want, strict=True)), key=key)
    assert fm.digests(df.limit(0)).count() == 0 and fm.transform(df.where("doc_id is null")).count() == 1


def test_options(spark):
    o = fm.Options(plain_from=100, suffix_first_below=100, seed="it's:", prefix="<|p|>", suffix="<|s'|>", middle="<|m|>")
    df = spark.createDataFrame([(i, f"some words {i} here <P>") for i in range(40)], "doc_id long, text string")
    made = fm.transform(df, o)
    assert {r.form for r in made.collect()} == {"spm"} and all(r.output.startswith("<|s'|>") for r in made.collect())
    assert sorted(fm.restore(made, o).collect()) == sorted(df.collect())
