import hashlib
import random
import re

import duckdb
import pandas as pd

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from pagelattice.llm import source_mix


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    docs, labels = [], []
    for i in range(260):
        w = [rng.choice(vocab) for _ in range(rng.randint(8, 80))]
        y = int(i % 5 == 0)
        for _ in range(4 * y):
            w.insert(rng.randrange(len(w)), rng.choice(("vile", "nastyer", "nastyest")))
        docs.append((i, " ".join(w), "en", f"s{i % 3}", 1))
        labels.append((i, 1, y))
    for i in range(300, 330):  # exact and near copies of clean documents
        t = docs[i - 299][1]
        docs.append((i, t.replace(" ", "  ") if i % 2 else t + " tail", "en", "s0", 1))
    docs += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_and_run(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert docs.columns == columns
        rows = docs.collect()
        counts.append(len(rows))
        ids = {r.doc_id for r in rows}
        if name == "toxicity":
            assert not ids & set(range(0, 260, 5)) and len(ids) == 208 + 32 - sum(1 for i in range(300, 330) if (i - 299) % 5 == 0)
        if name == "near_dedup":  # one of each group stays; the two empty rows are one group of equal texts
            assert all(len(ids & {i, i - 299}) == 1 for i in range(300, 330) if (i - 299) % 5) and len(ids & {400, 401}) == 1
        docs = spark.createDataFrame(rows, docs.schema)
        texts = {r.doc_id: r.text for r in rows} if name == "mix" else None if name != "bpe" else texts  # noqa: F821
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, rows))


def brute(sf_dir, spark):
    """The rows of run(), by plain means: planted toxic rows go; of texts equal without white space the longest stays, then the smallest id; of
    those linked at 0.8 by sets of five words the smallest id; copies by the SQL of the mix; tokens by the library."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if not re.search("vile|nastyer|nastyest", r.text or "")}
    best = {}
    for i, r in rows.items():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        rank = (len(r.text or ""), -i)
        best[key] = max(best.get(key, (rank, i)), (rank, i))
    rows = {i: rows[i] for _, i in best.values()}
    sets = {}
    for i, r in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {i: i for i in rows}
    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    rows = {i: r for i, r in rows.items() if group[i] == i}
    con = duckdb.connect()
    con.register("kept", pd.DataFrame([(r.doc_id, r.text, r.source) for r in rows.values()], columns=["doc_id", "text", "source"]))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, size, _, _, taken in con.execute(source_mix.oracle("kept")).fetchall():
        ids = library.encode(rows[i].text or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out += [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] * (taken // size if size else 0)
    return out, {i for i, r in rows.items() if not (r.text or "").split()}


def test_run_by_plain_means(spark, sf_dir):
    want, empty = brute(sf_dir, spark)
    got = [tuple(r) for r in cp.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    # how often a text without words is taken says nothing about words; its draw is its source's rate all the same
    assert sorted(r for r in got if r[0] not in empty) == sorted(r for r in want if r[0] not in empty)
    assert {r[0] for r in got} - empty == {r[0] for r in want} and len(want) > 200
