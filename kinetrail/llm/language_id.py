"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` UTF-8 bytes in both directions, labels
every position with language probabilities, and a document's probabilities are
the mean over all positions of all its windows: whole texts count. It is trained
in numpy by backpropagation through time (Adam) on a bounded sample: of every
language the documents with the least hash in each of ``PER_LANGUAGE`` hash slots, at
most ``TRAIN_DOCS`` in all, so rare languages are learned too; of each ``TRAIN_WINDOWS``
windows, drawn by hash from the whole text. The weights are a few thousand numbers and
travel with the task; inference is numpy over Arrow batches, with no shuffle. The state
starts anew in each window: the first and last few bytes of a window are read with
context on one side only, which the mean over all positions evens out.

Defined results. A text that is null or has no letter is ``und`` with score 0. If
no labelled row exists, every text is ``und``. Rows are answered one by one, so
repeated rows repeat their answer; an empty table gives an empty table. A last
window is padded with zero bytes, which do not count in the mean.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table, tidy
from .shingles import column_slices

WINDOW, HIDDEN, EMBED, LANES = 64, 8, 8, 2048
TRAIN_DOCS, PER_LANGUAGE, TRAIN_WINDOWS, STEPS, BATCH, SEED, SLICE = 4000, 1000, 4, 300, 128, 7, 1 << 21
UND, MIN_SCORE = "und", 0.3
_LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def init_weights(classes: int, seed: int = SEED) -> dict:
    rng, s = np.random.default_rng(seed), 0.3
    w = {"E": rng.normal(0, s, (256, EMBED)), "V": rng.normal(0, s, (2 * HIDDEN, classes)), "c": np.zeros(classes)}
    for d in "fb":
        w |= {f"W{d}": rng.normal(0, s, (EMBED, 3 * HIDDEN)), f"U{d}": rng.normal(0, s, (HIDDEN, 3 * HIDDEN)), f"a{d}": np.zeros(3 * HIDDEN)}
    return w


def loss_and_gradient(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over unmasked positions, and its gradient through time."""
    n, steps, h = *x.shape, HIDDEN
    e = w["E"][x]
    states, kept = {}, {}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        gates, hid, out, tape = e @ w[f"W{d}"] + w[f"a{d}"], np.zeros((n, h)), np.zeros((n, steps, h)), {}
        for t in order:
            g = hid @ w[f"U{d}"]
            zr = _sigmoid(gates[:, t, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[:, t, 2 * h :] + r * g[:, 2 * h :])
            tape[t] = (hid, z, r, new, g[:, 2 * h :])
            hid = (1 - z) * new + z * hid
            out[:, t] = hid
        states[d], kept[d] = out, tape
    both = np.concatenate([states["f"], states["b"]], axis=2)
    logits = both @ w["V"] + w["c"]
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    count = max(1.0, mask.sum())
    loss = -(np.log(np.take_along_axis(p, y[:, None, None], 2)[:, :, 0] + 1e-30) * mask).sum() / count
    p[np.arange(n), :, y] -= 1
    p *= mask[:, :, None] / count
    grad = {"V": np.einsum("nth,ntk->hk", both, p), "c": p.sum((0, 1)), "E": np.zeros_like(w["E"])}
    back = p @ w["V"].T
    de = np.zeros_like(e)
    for k, (d, order) in enumerate((("f", range(steps - 1, -1, -1)), ("b", range(steps)))):
        dout, dh, dgates, du = back[:, :, k * h : (k + 1) * h], np.zeros((n, h)), np.zeros((n, steps, 3 * h)), np.zeros_like(w[f"U{d}"])
        for t in order:
            prev, z, r, new, g = kept[d][t]
            dh = dh + dout[:, t]
            da = dh * (1 - z) * (1 - new * new)
            dz, dr = dh * (prev - new) * z * (1 - z), da * g * r * (1 - r)
            dgates[:, t] = np.concatenate([dz, dr, da], axis=1)
            dg = np.concatenate([dz, dr, da * r], axis=1)
            du += prev.T @ dg
            dh = dh * z + dg @ w[f"U{d}"].T
        grad |= {f"U{d}": du, f"a{d}": dgates.sum((0, 1)), f"W{d}": np.einsum("nte,ntg->eg", e, dgates)}
        de += dgates @ w[f"W{d}"].T
    np.add.at(grad["E"], x, de)
    return float(loss), grad


def train(windows: list[list[str]], labels: list[int], classes: int, steps: int = STEPS, seed: int = SEED) -> dict:
    """Weights from windows of labelled texts."""
    rng = np.random.default_rng(seed)
    rows, lengths, y = [], [], []
    for own, label in zip(windows, labels):
        for t in own:
            raw = np.frombuffer(t.encode()[:WINDOW], np.uint8)
            size = len(raw) if rng.random() < 0.6 else min(len(raw), int(rng.integers(4, WINDOW + 1)))
            rows.append(np.pad(raw[:size], (0, WINDOW - size)))
            lengths.append(size)
            y.append(label)
    x, lengths, y = np.stack(rows), np.array(lengths), np.array(y)
    mask = (np.arange(WINDOW)[None, :] < lengths[:, None]).astype(np.float64)
    w = init_weights(classes, seed)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for i in range(1, steps + 1):
        pick = rng.integers(0, len(x), min(BATCH, len(x)))
        _, grad = loss_and_gradient(w, x[pick], mask[pick], y[pick])
        rate = 0.02 * (1 - (i - 1) / steps) + 0.001
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return w


class Labeller:
    """Inference: byte tables replace the embedding, lanes are windows."""

    def __init__(self, w: dict):
        f = lambda a: np.ascontiguousarray(a, np.float32)
        self.tables = {d: f((w["E"] @ w[f"W{d}"] + w[f"a{d}"]).T) for d in "fb"}
        self.u = {d: f(w[f"U{d}"].T) for d in "fb"}
        self.v, self.c = f(w["V"].T), f(w["c"])[:, None]
        self.classes = len(w["c"])

    def _pass(self, x: np.ndarray, d: str, order) -> np.ndarray:
        h, n = HIDDEN, x.shape[1]
        out, hid = np.empty((len(x), h, n), np.float32), np.zeros((h, n), np.float32)
        for t in order:
            a = np.take(self.tables[d], x[t], axis=1)
            g = self.u[d] @ hid
            zr = a[: 2 * h]
            zr += g[: 2 * h]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            new = g[2 * h :]
            new *= zr[h:]
            new += a[2 * h :]
            np.tanh(new, out=new)
            hid = out[t]
            np.subtract(out[t - 1 if d == "f" else t + 1] if 0 <= (t - 1 if d == "f" else t + 1) < len(x) else 0.0, new, out=hid)
            hid *= zr[:h]
            hid += new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """x (positions, lanes) bytes; probabilities (positions, classes, lanes)."""
        steps = len(x)
        f, b = self._pass(x, "f", range(steps)), self._pass(x, "b", range(steps - 1, -1, -1))
        p = np.matmul(self.v[:, :HIDDEN], f)
        p += np.matmul(self.v[:, HIDDEN:], b)
        p += self.c
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def documents(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Mean position probabilities (documents, classes) of byte ranges of ``data``."""
        per = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(sizes)), per)
        first = np.repeat(np.cumsum(per) - per, per)
        at = starts[doc] + (np.arange(len(doc)) - first) * WINDOW
        left = np.minimum(starts[doc] + sizes[doc] - at, WINDOW)
        sums = np.zeros((len(sizes), self.classes))
        inside = np.arange(WINDOW)[:, None]
        for k in range(0, len(doc), LANES):
            a, n, own = at[k : k + LANES], left[k : k + LANES], doc[k : k + LANES]
            index = np.minimum(a[None, :] + inside, len(data) - 1)
            valid = inside < n[None, :]
            p = self.positions(np.where(valid, data[index], 0))
            p = np.einsum("tkn,tn->kn", p, valid.astype(np.float32))
            for c in range(self.classes):
                sums[:, c] += np.bincount(own, p[c], len(sizes))
        return sums / np.maximum(sizes, 1)[:, None]


def _run(w: dict | None, languages: list[str], kept: list[int]):
    """The text is the first column; the columns ``kept`` go on."""

    def run(batches):
        import pyarrow as pa

        model = Labeller(w) if w is not None else None
        for batch in batches:
            for lo, hi, own in column_slices(batch.column(0), SLICE):
                b, texts = batch.slice(lo, hi - lo), [None if x is None else x.decode() for x in own]
                lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in texts])
                found, score = [UND] * len(texts), np.zeros(len(texts))
                if model is not None and lettered.any():
                    raw = [texts[i].encode() for i in np.flatnonzero(lettered)]
                    sizes = np.array([len(r) for r in raw], np.int64)
                    p = model.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
                    best = p.argmax(1)
                    for i, c, q in zip(np.flatnonzero(lettered), best, p):
                        found[i], score[i] = languages[c], min(1.0, max(0.0, float(q[c])))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.array(found, pa.string()), pa.array(score)], names=[*[f"__li_{i}" for i in range(len(kept))], "lang_pred", "lang_score"])

    return run


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[dict | None, list[str]]:
    """Weights and language names from a bounded sample of ``labelled``, see above."""
    t, draw = F.col("t"), F.xxhash64(F.lit(23), "k")
    places = [F.pmod(F.xxhash64(F.lit(i), "k"), F.greatest(F.length(t) - WINDOW + 1, F.lit(1))).cast("int") + 1 for i in range(TRAIN_WINDOWS)]
    rows = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).filter("l is not null").filter(F.coalesce(t.rlike(r"\p{L}"), F.lit(False)))
    windows = rows.select("l", draw.alias("draw"), F.pmod(draw, F.lit(PER_LANGUAGE)).alias("slot"), F.array(*[F.substring(t, p, F.lit(WINDOW)) for p in places]).alias("w"))
    least = windows.groupBy("l", "slot").agg(F.min(F.struct("draw", "w")).alias("r"))
    sample = least.orderBy("slot", "l").limit(TRAIN_DOCS).select("l", "r.w").collect()
    languages = sorted({r["l"] for r in sample})
    if not sample:
        return None, []
    return train([r["w"] for r in sample], [languages.index(r["l"]) for r in sample], len(languages)), languages


def identify(docs: DataFrame, w: dict | None, languages: list[str], text: str = "text", pred: str = "lang_pred", score: str = "lang_score", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with two columns at the end; columns of such names are replaced.

    The text goes to the workers once, and comes back only with ``keep_text``.
    """
    kept = [f for f in docs.schema.fields if f.name not in (pred, score) and (keep_text or f.name != text)]
    names = [f"__li_{i}" for i in range(len(kept))]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__li_text"), *[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names) if f.name != text])
    place = {n: i for i, n in enumerate(rows.columns)}
    places = [0 if f.name == text else place[n] for f, n in zip(kept, names)]
    kinds = "".join(f"{n} {'string' if f.name == text else f.dataType.simpleString()}, " for n, f in zip(names, kept))
    out = rows.mapInArrow(tidy(_run(w, languages, places)), f"{kinds}lang_pred string, lang_score double")
    return out.select(*[F.col(n).alias(f.name) for n, f in zip(names, kept)], F.col("lang_pred").alias(pred), F.col("lang_score").alias(score))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 3) == 1
    w, languages = fit(docs.filter(~F.coalesce(held, F.lit(True))))
    found = identify(docs.select("doc_id", "text"), w, languages, keep_text=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
