"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels mark documents, so tokens are labelled first: on a bounded sample of
labelled documents (``TRAIN_DOCS``, whole texts) every word and every word start of ``STEMS``
characters gets the lower confidence bound of its log-odds for toxic documents,
counted over groups of near-equal documents (by the smallest hash of three words)
so that copies do not vote twice; a word counts with the best of its own and its starts'
bounds, so unseen forms of a known stem are found. In toxic documents the words
with a high bound are toxic tokens, every other token is clean. The field
has two states; its features are the odds buckets of a token and of its two
neighbours. It is fitted in numpy by gradient ascent on the log-likelihood with
forward-backward expectations, on one half of the sample with the odds of the
other half, so that no document is judged by words it has voted for; the final odds
come from both halves. A document's score comes from its marginals, by a
logistic calibration of the largest marginal and of their sum; tokens with a
marginal of one half or more make the offending spans.

Whole texts are tagged: lanes are documents of one Arrow slice, longest first, and
the chain runs over the lanes that are still going.

Defined results. A null or word-less text has no token: its score is that of
marginals of zero. Without labelled rows of both kinds every score is the sample's
share of toxic rows (0 without rows). Rows are answered one by one, so repeated
rows repeat their answer; an empty table gives an empty table. Offsets count code
points, the end is exclusive.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, fold, table
from .shingles import column_slices

TRAIN_DOCS, STEPS, RATE, PENALTY = 4000, 40, 0.2, 1e-3
STEMS, CACHE = range(3, 8), 200_000
EDGES = (-1.0, -0.3, 0.3, 1.0, 1.6, 2.2, 3.0, 4.0, 5.0)  # of odds buckets; bucket 0 is an unknown word
TOXIC_BOUND, LEAST_DOCS, PREDICT, SLICE = 1.6, 3, 0.3, 1 << 21
BUCKETS = len(EDGES) + 2
WORD = re.compile(r"\w+")


def words(t: str | None) -> list[str]:
    return WORD.findall(t) if t else []


def keys(w: str) -> list[str]:
    """The word, and its starts as ``start*``."""
    return [w, *(w[:k] + "*" for k in STEMS if len(w) >= k)]


def lexicon(docs: list[list[str]], labels: list[int]) -> dict[str, int]:
    """Key to bucket, for keys with evidence either way; all others are bucket 0."""
    counts, totals = (Counter(), Counter()), [{}, {}]
    for i, (tokens, y) in enumerate(zip(docs, labels)):
        group = min((zlib.crc32(" ".join(tokens[k : k + 3]).encode()) for k in range(max(1, len(tokens) - 2))), default=0) if tokens else -1 - i
        totals[y].setdefault(group, set()).update(tokens)
    for y in (0, 1):
        for kinds in totals[y].values():
            counts[y].update({k for w in kinds for k in keys(w)})
    n0, n1 = max(1, len(totals[0])), max(1, len(totals[1]))
    even, out = 1 + int(np.searchsorted(EDGES, 0.0)), {}
    for w in counts[0].keys() | counts[1].keys():
        a, c = counts[1][w], counts[0][w]
        if a + c >= LEAST_DOCS:
            odds = math.log((a + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
            spread = math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5))
            bucket = 1 + int(np.searchsorted(EDGES, odds - spread if odds > 0 else odds + spread))
            if bucket > even or bucket < even and not w.endswith("*"):
                out[w] = bucket
    return out


class Buckets(dict):
    """Word to bucket, remembered up to CACHE words: the best of its keys."""

    def __init__(self, lex: dict[str, int]):
        super().__init__()
        self.lex = lex

    def __missing__(self, w: str) -> int:
        found = [self.lex[k] for k in keys(w.lower()) if k in self.lex]
        if len(self) >= CACHE:
            self.clear()
        self[w] = best = max(found, default=0)
        return best


def features(buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Feature numbers (tokens, 3) of own, previous and next bucket; edges count as bucket 0."""
    prev, after = np.roll(buckets, 1), np.roll(buckets, -1)
    ends = np.cumsum(sizes)
    own = sizes > 0
    prev[(ends - sizes)[own]] = 0
    after[ends[own] - 1] = 0
    return np.stack([buckets, prev + BUCKETS, after + 2 * BUCKETS], axis=1)


def forward_backward(emit: np.ndarray, sizes: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Normalised messages (tokens, 2) both ways and the log-likelihood's normaliser.

    emit (tokens, 2), move (2, 2) and start (2,) are potentials, not logarithms.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    alpha, beta = np.ones_like(emit), np.ones_like(emit)
    norm, steps = 0.0, int(lengths[0]) if len(lengths) else 0
    going = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than t
    a = None
    for t in range(steps):
        at = starts[: going[t]] + t
        a = (a[: going[t]] @ move if t else start[None, :]) * emit[at]
        s = a.sum(1, keepdims=True)
        a /= s
        norm += np.log(s).sum()
        alpha[at] = a
    b = np.ones((0, 2))
    for t in range(steps - 2, -1, -1):
        at = starts[: going[t + 1]] + t
        b = np.concatenate([b, np.ones((going[t + 1] - len(b), 2))]) if len(b) < going[t + 1] else b
        b = (b * emit[at + 1]) @ move.T
        b /= b.sum(1, keepdims=True)
        beta[at] = b
    return alpha, beta, norm


def marginals(w: dict, f: np.ndarray, sizes: np.ndarray):
    """Probability of the toxic state per token, with what the gradient needs."""
    emit = np.ones((len(f), 2))
    emit[:, 1] = np.exp(np.clip(w["emit"][f].sum(1) + w["bias"], -30, 30))
    move, start = np.exp(w["move"]), np.exp(w["start"])
    alpha, beta, norm = forward_backward(emit, sizes, move, start)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma[:, 1], (alpha, beta, emit, move, gamma, norm)


def fit_field(f: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> dict:
    """Weights that maximise the penalised log-likelihood of the token labels."""
    w = {"emit": np.zeros(3 * BUCKETS), "bias": np.zeros(1), "move": np.zeros((2, 2)), "start": np.zeros(2)}
    n, own = len(f), sizes > 0
    first = (np.cumsum(sizes) - sizes)[own]
    inner = np.ones(n, bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    gold = {"emit": np.bincount(f[y == 1].ravel(), minlength=3 * BUCKETS).astype(float), "bias": np.array([y.sum()], float), "move": np.bincount(2 * y[later - 1] + y[later], minlength=4).reshape(2, 2).astype(float), "start": np.bincount(y[first], minlength=2).astype(float)}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for i in range(1, STEPS + 1):
        p, (alpha, beta, emit, move, gamma, _) = marginals(w, f, sizes)
        pair = alpha[later - 1][:, :, None] * move[None] * (emit[later] * beta[later])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        hoped = {"emit": np.bincount(f.ravel(), np.repeat(p, 3), 3 * BUCKETS), "bias": np.array([p.sum()]), "move": pair.sum(0), "start": gamma[first].sum(0)}
        for k in w:
            g = (gold[k] - hoped[k]) / max(1, gold["bias"][0]) - PENALTY * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            w[k] = w[k] + RATE * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)
    return w


def _summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: logit of the largest marginal, log of the sum, and 1."""
    most, total, own = np.zeros(len(sizes)), np.zeros(len(sizes)), sizes > 0
    at = (np.cumsum(sizes) - sizes)[own]
    if len(at):
        most[own], total[own] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
    most = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.log(most / (1 - most)) / 5, np.log(total + 1e-2) / 3, np.ones(len(sizes))], axis=1)


def _encode(texts: list[list[str]], buckets: Buckets):
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.fromiter((buckets[w] for t in texts for w in t), np.int64, int(sizes.sum())), sizes


def train(texts: list[str], labels: list[int]) -> dict:
    """A model from labelled texts; it is a few kilobytes plus the lexicon."""
    share = sum(labels) / len(labels) if labels else 0.0
    if not labels or share in (0.0, 1.0):
        return {"share": share}
    shared = {}  # one object a word: whole texts repeat words often
    docs = [[shared.setdefault(w, w) for w in words(t.lower())] for t in texts]
    order = sorted(range(len(docs)), key=lambda i: zlib.crc32(texts[i].encode()))
    half = [order[0::2], order[1::2]]
    if any(len({labels[i] for i in h}) < 2 for h in half):
        half = [order, order]
    lex = lexicon([docs[i] for i in half[0]], [labels[i] for i in half[0]])
    own = np.array([labels[i] for i in half[1]])
    buckets, sizes = _encode([docs[i] for i in half[1]], Buckets(lex))
    toxic_from = 1 + int(np.searchsorted(EDGES, TOXIC_BOUND, side="right"))
    y = ((buckets >= toxic_from) & (np.repeat(own, sizes) == 1)).astype(np.int64)
    w = fit_field(features(buckets, sizes), y, sizes)
    seen, even = np.bincount(features(buckets, sizes).ravel(), minlength=3 * BUCKETS), 1 + int(np.searchsorted(EDGES, 0.0))
    for b in range(even + 2, BUCKETS):  # stronger evidence than the half has seen weighs as the strongest seen
        for k in range(b, 3 * BUCKETS, BUCKETS):
            if not seen[k]:
                w["emit"][k] = w["emit"][k - 1]
    x, target = _summary(marginals(w, features(buckets, sizes), sizes)[0], sizes), own.astype(float)
    c = np.zeros(3)
    for _ in range(30):  # Newton's method with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (target - q) - 0.1 * c
        c = c + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3), grad)
    return {"share": share, "lexicon": lexicon(docs, labels), "field": w, "calibration": c}


def score_texts(model: dict, texts: list[str | None], known: Buckets | None = None):
    """Scores, and the offending spans [(start, end, probability)] of each text."""
    if "field" not in model:
        return np.full(len(texts), model["share"]), [[] for _ in texts]
    docs = [words(t) for t in texts]
    buckets, sizes = _encode(docs, known if known is not None else Buckets(model["lexicon"]))
    p, _ = marginals(model["field"], features(buckets, sizes), sizes)
    score = 1 / (1 + np.exp(-np.clip(_summary(p, sizes) @ model["calibration"], -30, 30)))
    spans, at = [], np.cumsum(sizes) - sizes
    for t, a, n in zip(texts, at, sizes):
        own, out = p[a : a + n], []
        if n and own.max() >= 0.5:
            for m, q in zip(WORD.finditer(t), own):
                if q >= 0.5:
                    out.append((m.start(), m.end(), float(q)))
        spans.append(out)
    return score, spans


def _run(shared):
    def run(batches):
        import pyarrow as pa

        model = shared.value
        known = Buckets(model.get("lexicon", {}))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for batch in batches:
            for lo, hi, raw in column_slices(batch.column(1), SLICE):
                score, spans = score_texts(model, [None if x is None else x.decode() for x in raw], known)
                spans = [[dict(zip(("start", "end", "probability"), x)) for x in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score), pa.array(spans, kind)], names=["__tx_key", "score", "spans"])

    return run


def fit(labelled: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> dict:
    """A model from the whole texts of at most TRAIN_DOCS labelled rows."""
    rows = labelled.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")
    sample = sorted((r["t"], r["y"]) for r in bounded_rows(rows, "k", TRAIN_DOCS))
    return train([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, score and spans array<struct<start,end,probability>>.

    The model's lexicon comes from the bounded sample, so its broadcast is bounded.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__tx_key"), F.col(text).cast("string").alias("__tx_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_run(shared), f"__tx_key {kind}, score double, spans array<struct<start:long,end:long,probability:double>>").withColumnRenamed("__tx_key", key)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), fold("doc_id", 4) == 2
    labels = table(spark, sf_dir, "labels").filter(~F.coalesce(held, F.lit(True)) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(TRAIN_DOCS)
    model = fit(docs.join(F.broadcast(chosen), "doc_id"))
    found = score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "spans")
