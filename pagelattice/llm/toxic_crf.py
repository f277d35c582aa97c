"""Toxicity by a linear-chain conditional random field over tokens.

Training (driver, on a bounded sample of labelled rows): tokens of toxic documents whose word or word-beginning is
far commoner in toxic documents than in clean ones are labelled toxic, all others clean; a two-state CRF is fitted to these
token labels by forward-backward gradients. Its features are a token's word, beginnings of 3 to 5 letters and ending of
3; its chain weights are the four transitions. A logistic layer turns a document's marginals (sum, largest, rate) into its score.

Scoring (a map over all documents, whole texts): forward and backward run over all documents of a slice in lockstep, longest
first. Nothing is shuffled. The model is a few arrays with a documented bound.

Defined results: null and empty texts have no tokens and get the score of the logistic layer at zero evidence; repeated rows get
equal scores; where no row of one of the classes is labelled, every score is the share of toxic training rows (0 without any); a
labelled id that several rows have is learned from its least text, and is toxic if any of its labels says so; an empty table gives an
empty result; labels, lang, source, doc_id and columns of other names are never inputs of a score. The sample is put in order of a hash
of the ids before anything is fitted, so scores don't depend on how rows are partitioned.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import hashing as hs

#: Bounds of the training sample: rows of each class, and characters altogether.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000_000
#: Token labels: documents (and share of the toxic ones) that must have a feature, the log-odds that it must reach, and most
#: features kept. Features of fewer documents are as a rule those of a few copies.
SEED_DOCS, SEED_SHARE, SEED_ODDS, MOST_FEATURES = 4, 0.02, 3.0, 150_000
STEPS, L2, CLIP = 40, 2e-4, 12.0
MEMO = 200_000
#: Bytes of text that a worker holds at a time; what it makes of them is a few times that.
SLICE = 4 << 20
_CORE = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_TOKENS = re.compile(common.WORD)


def features(token: str) -> list[str]:
    """The features of a white-space token: of its first run of letters or digits, lower case."""
    core = _CORE.search(token)
    if not core:
        return []
    w = core[0].lower()
    return [w, *(f"{w[:n]}*" for n in (3, 4, 5) if len(w) > n), *([f"*{w[-3:]}"] if len(w) > 3 else [])]


class Lockstep:
    """Tokens of many sequences, put in order of time, so that all sequences step together."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ordered = sizes[self.order]
        self.steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(self.steps), side="left")  # sequences longer than t
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        lane = np.empty(len(sizes), np.int64)
        lane[self.order] = np.arange(len(sizes))
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        t = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
        self.place = self.at[t] + np.repeat(lane, sizes) if len(t) else t

    def spread(self, values: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[self.place] = values
        return out


def forward_backward(e: np.ndarray, trans: np.ndarray, steps: Lockstep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered odds, backward ratios and marginals of state 1; e: weight of state 1 over state 0, in Lockstep order.

    trans: exp of the transition weights, rows are the earlier state."""
    up = np.exp(e)
    p = np.empty_like(e)  # P(state 1 | tokens so far)
    b = np.ones_like(e)  # backward message, state 1 over state 0
    at, act = steps.at, steps.active
    a00, a01, a10, a11 = trans.ravel()
    for t in range(steps.steps):
        s = slice(at[t], at[t + 1])
        if t:
            q = p[at[t - 1] : at[t - 1] + act[t]]
            r = up[s] * (a01 + (a11 - a01) * q) / (a00 + (a10 - a00) * q)
        else:
            r = up[s] * (a01 / a00)  # before the first token the state is clean
        p[s] = r / (1 + r)
    for t in range(steps.steps - 2, -1, -1):
        n = act[t + 1]
        u = up[at[t + 1] : at[t + 1] + n] * b[at[t + 1] : at[t + 1] + n]
        b[at[t] : at[t] + n] = (a10 + a11 * u) / (a00 + a01 * u)
    marg = p * b / (1 - p + p * b)
    return p, b, marg


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    layer: np.ndarray | None = None  # of (1, log1p sum, max, rate); None: constant
    constant: float = 0.0

    def emission(self, token: str) -> float:
        get = self.weights.get
        x = self.bias + sum([get(f, 0.0) for f in features(token)])
        return max(-CLIP, min(CLIP, x))


class Scorer:
    """Scores slices of texts; remembers the weights of tokens, up to MEMO of them."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[bytes, float] = {}

    def marginals(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and the marginals of all tokens in order."""
        sizes, found = hs.words(texts)
        coded = found.dictionary_encode()
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        weights = np.empty(len(coded.dictionary))
        for i, w in enumerate(coded.dictionary.to_numpy(zero_copy_only=False).tolist()):
            if (x := memo.get(w)) is None:
                x = memo[w] = self.model.emission(w.decode())
            weights[i] = x
        e = weights[coded.indices.to_numpy(zero_copy_only=False)]
        steps = Lockstep(sizes)
        _, _, marg = forward_backward(steps.spread(e), self.model.trans, steps)
        return sizes, marg[steps.place]

    def score(self, sizes: np.ndarray, marg: np.ndarray) -> np.ndarray:
        if self.model.layer is None:
            return np.full(len(sizes), self.model.constant)
        return 1 / (1 + np.exp(-evidence(sizes, marg) @ self.model.layer))


def evidence(sizes: np.ndarray, marg: np.ndarray) -> np.ndarray:
    """What the logistic layer sees of each document."""
    total, top = np.zeros(len(sizes)), np.zeros(len(sizes))
    full = np.flatnonzero(sizes)
    if len(full):
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
        total[full], top[full] = np.add.reduceat(marg, begin), np.maximum.reduceat(marg, begin)
    return np.column_stack((np.ones(len(sizes)), np.log1p(total), top, np.sqrt(total / np.maximum(sizes, 1))))


def fit(texts: list[str], toxic: np.ndarray, share: float) -> Model:
    """A model of labelled texts; share: the share of toxic rows among all labelled training rows.

    Every third text of each class is left to the logistic layer, which so sees marginals as new texts have them."""
    if not len(texts) or toxic.all() or not toxic.any():
        return Model(constant=float(share))
    place = np.where(toxic == 1, np.cumsum(toxic == 1), np.cumsum(toxic == 0))
    later = (place % 3 == 0) & (np.bincount(toxic, minlength=2).min() >= 6)
    model = fit_chain([t for t, x in zip(texts, later, strict=True) if not x], toxic[~later])
    pick = later if later.any() else np.ones(len(texts), bool)
    sizes, marg = Scorer(model).marginals([t for t, x in zip(texts, pick, strict=True) if x])
    x, t = evidence(sizes, marg), toxic[pick].astype(np.float64)
    per = np.where(t == 1, share / max(t.sum(), 1), (1 - share) / max((1 - t).sum(), 1))
    theta = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's steps of weighted logistic regression
        q = 1 / (1 + np.exp(-x @ theta))
        h = (x * (per * q * (1 - q) + 1e-12)[:, None]).T @ x + 1e-5 * np.eye(len(theta))
        theta = theta + np.clip(np.linalg.solve(h, x.T @ (per * (t - q)) - 1e-5 * theta), -2, 2)
    model.layer = theta
    return model


def fit_chain(texts: list[str], toxic: np.ndarray) -> Model:
    """Token labels and the chain's weights."""
    sizes, found = hs.words(texts)
    coded = found.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(ids):
        return Model()
    of_word = [tuple(map(sys.intern, features(w.decode()))) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]  # words share beginnings
    n_words = len(of_word)
    del found, coded
    df = {0: Counter(), 1: Counter()}
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for d, y in enumerate(toxic.tolist()):
        df[y].update({f for w in set(ids[begin[d] : begin[d + 1]].tolist()) for f in of_word[w]})
    n1, n0 = int(toxic.sum()), int((~toxic.astype(bool)).sum())
    kept = [f for f, n in sorted((df[0] + df[1]).items(), key=lambda x: (-x[1], x[0]))[:MOST_FEATURES] if n >= SEED_DOCS]
    number = {f: i for i, f in enumerate(kept)}
    seeds = {f for f, n in df[1].items() if n >= max(SEED_DOCS, SEED_SHARE * n1) and np.log((n + 0.5) / (n1 + 1)) - np.log((df[0][f] + 0.5) / (n0 + 1)) >= SEED_ODDS}
    seed_word = np.array([any(f in seeds for f in fs) for fs in of_word], bool)
    y = seed_word[ids] & np.repeat(toxic.astype(bool), sizes)
    # word x feature, as two flat arrays
    flat_w, flat_f = array("q"), array("q")
    for w, fs in enumerate(of_word):
        for f in fs:
            if f in number:
                flat_w.append(w)
                flat_f.append(number[f])
    pw, pf = np.array(flat_w, np.int64), np.array(flat_f, np.int64)
    del of_word, df, seeds, flat_w, flat_f, number
    steps = Lockstep(sizes)
    words = steps.spread(ids)
    gold = steps.spread(y.astype(np.float64))
    prev = np.full(len(words), -1)  # place of the token before
    for t in range(1, steps.steps):
        prev[steps.at[t] : steps.at[t + 1]] = steps.at[t - 1] + np.arange(steps.active[t])
    has = prev >= 0
    gp = np.where(has, gold[prev], 0.0)
    gold_trans = np.array([[((1 - gp) * (1 - gold)).sum(), ((1 - gp) * gold).sum()], [(gp * (1 - gold)).sum(), (gp * gold).sum()]])
    gold_word = np.bincount(words, gold, n_words)
    w, bias, trans = np.zeros(len(kept)), -3.0, np.zeros((2, 2))
    g2w, g2b, g2t = np.full(len(kept), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(STEPS):
        e_word = np.clip(bias + np.bincount(pw, w[pf], n_words), -CLIP, CLIP)
        e = e_word[words]
        tr = np.exp(trans)
        p, b, marg = forward_backward(e, tr, steps)
        # pair marginals: filtered state of the token before, transition, this token, what follows
        pp = np.where(has, p[prev], 0.0)
        u = np.exp(e) * b
        del e, p, b
        pair = [lambda: (1 - pp) * tr[0, 0], lambda: (1 - pp) * tr[0, 1] * u, lambda: pp * tr[1, 0], lambda: pp * tr[1, 1] * u]  # noqa: B023  one at a time: each is as long as the sample
        whole = pair[0]()
        for k in (1, 2, 3):
            whole += pair[k]()
        of_pairs = np.array([(f() / whole).sum() for f in pair]).reshape(2, 2)
        d_word = gold_word - np.bincount(words, marg, n_words)
        scale = 1.0 / len(words)
        gw = np.bincount(pf, d_word[pw], len(kept)) * scale - L2 * w * scale * 10
        gb = d_word.sum() * scale
        gt = (gold_trans - of_pairs) * scale
        g2w, g2b, g2t = g2w + gw**2, g2b + gb**2, g2t + gt**2
        w, bias, trans = w + 0.5 * gw / np.sqrt(g2w), bias + 0.5 * gb / np.sqrt(g2b), trans + 0.2 * gt / np.sqrt(g2t)
    return Model({f: float(x) for f, x in zip(kept, w, strict=True) if abs(x) > 1e-3}, float(bias), np.exp(trans))


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labelled rows that are not held out: at most SAMPLE_ROWS of each class, by a hash of their ids."""
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") != 0).alias("y")).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return Model()
    known = known.withColumn("place", F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    picked = [known.where(F.col("y") == y).orderBy("place").limit(SAMPLE_ROWS) for y in (True, False)]
    wanted = picked[0].unionByName(picked[1])
    # both sides are bounded by SAMPLE_ROWS, so the ids may be broadcast
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    texts, y, held = [], [], 0
    for r in rows.groupBy("place", "y").agg(F.min("text").alias("text")).orderBy("place").toLocalIterator():
        texts.append(r.text)
        y.append(r.y)
        held += len(r.text)
        if held > SAMPLE_CHARS:
            break
    return fit(texts, np.array(y, np.int64), counts.get(True, 0) / sum(counts.values()))


def spans(text: str, marg: np.ndarray, at: float = 0.5) -> list[tuple[int, int]]:
    """Runs of tokens with a marginal of `at` or more, as character offsets."""
    out: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(_TOKENS.finditer(text)):
        if marg[i] >= at:
            out[-1:] = [(out[-1][0], m.end())] if last == i - 1 and out else [*out[-1:], (m.start(), m.end())]
            last = i
    return out


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs: the columns of SCHEMA; spans: character offsets of the toxic spans. A model without a fitted chain (no
    labels, or one class only) tells no token from another, so it has no spans; its score is the share of toxic labels."""
    box = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(box.value)
        for batch in common.slices(batches, "text", SLICE):
            texts = batch.column("text")
            sizes, marg = scorer.marginals(texts)
            score = scorer.score(sizes, marg)
            if box.value.layer is None:
                marg = np.zeros(len(marg))
            begin = np.concatenate(([0], np.cumsum(sizes)))
            hot = np.add.reduceat(np.concatenate((marg, [0.0])) >= 0.5, begin[:-1]) * (sizes > 0) if len(sizes) else sizes
            found = [[{"start": a, "end": b} for a, b in spans(texts[i].as_py(), marg[begin[i] : begin[i + 1]])] if hot[i] else [] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, _SPAN)], ["doc_id", "held_out", "score", "predicted", "spans"])
        common.trim()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id").cast("bigint")).alias("held_out"), "text")
    return rows.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't predict to be toxic. Only texts go through Python."""
    box = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def passes(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(box.value)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], ["text"])
            good = [scorer.score(*scorer.marginals(part.column("text"))) < 0.5 for part in common.slices(iter([batch]), "text", SLICE)]
            yield pa.array(np.concatenate(good) if good else np.zeros(0, bool))

    return docs.where(passes(F.col("text")))


def op3_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return tag(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
