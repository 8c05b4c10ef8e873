"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled once into: the normaliser (a prefix space, blanks become
the blank mark), an acceptor of all pieces with a weight each, and the byte
fallback for characters that no piece covers. An input composed with them is an
acyclic lattice whose states are text positions; the encoding is its shortest path
in the tropical semiring (weights add along a path, the least sum wins).

Unigram models weigh a piece with minus its score. In BPE models the scores rank
merges, and the segmentation is the one that merging makes: a pair of neighbouring
pieces has the weight one of the semiring (zero) if merging the two pieces' own text leaves
exactly these two, and its zero (infinity) otherwise. Both are tropical weights: along a
path they add up to zero if all pairs are legal, to infinity if one is not, and a text
has exactly one path of finite weight, its shortest. One min-plus relaxation over the
lazily composed lattice serves both kinds of model; only the order of its queue differs.
The result equals that of the library (see the tests), without its code.

Words, cut where no piece can span, are composed once and remembered in each worker, in two generations of
up to ``CACHE`` words; words in use stay.
Blanks never stand inside a piece in such models; where a model has pieces across
blanks the whole text is one input.

Defined results. A null or empty text has no ids. The blank mark itself counts as
a blank, so decoding gives a space there. Bytes that are no UTF-8 decode to the
replacement character. Rows are answered one by one; an empty table gives an empty
table. The output keeps the input's columns and adds ``ids`` and ``n_tokens``; a
column of the input with such a name is replaced.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, table, tidy
from .shingles import column_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, CACHE, PAIRS, SLICE = "▁", 200_000, 500_000, 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
INFINITE = float("inf")


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint(i):
        x = shift = 0
        while True:
            x |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return x, i

    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


def read_model(path: str = MODEL) -> dict:
    """Pieces (text, score, type) and the settings that shape the transducer."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, model = [], {"bpe": False, "prefix": True}
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, NORMAL)))
        elif number == 2:
            model["bpe"] = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only identity normalisers that keep blanks are compiled")
            model["prefix"] = bool(spec.get(3, 1))
    return model | {"pieces": pieces, "key": hashlib.sha256(data).hexdigest()}


class Transducer:
    """The compiled model: composes inputs and finds shortest paths."""

    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.bpe, self.prefix = model["bpe"], model["prefix"]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
        self.own = {p: p for p in self.ids}
        self.scores = [s for _, s, _ in pieces]
        self.starts = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids  # states of the acceptor; -1: not final
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.worst = min(self.scores, default=0.0) - 10.0
        out = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), USER: lambda p: p.replace(BLANK, " ").encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.text = [out.get(kind, lambda p: b"")(p) for p, _, kind in pieces]
        self.joins = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}  # neighbours inside some piece
        self.inputs = self._inputs().findall
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[str | None, dict[str, float]] = {}
        self.known_pairs = 0

    def _inputs(self) -> re.Pattern:
        """Blanks with what follows them: characters of one class, or one character of none.

        Two characters are of one class if pieces lead from one to the other by neighbours, so
        no piece spans two classes, nor a blank that ends what it holds.
        """
        to: dict[str, str] = {}

        def root(c):
            while to.setdefault(c, c) != c:
                c = to[c]
            return c

        for pair in self.joins:
            if BLANK not in pair:
                to[root(pair[0])] = root(pair[1])
        classes: dict[str, list[str]] = {}
        for c in sorted(to):
            classes.setdefault(root(c), []).append(c)
        own = [f"{BLANK}*[{''.join(map(re.escape, c))}]+" for c in sorted(classes.values(), key=len, reverse=True)]
        return re.compile("|".join([*own, f"{BLANK}*[^{BLANK}]", f"{BLANK}+"]))

    def merged(self, s: str) -> list[str]:
        """The pieces that merging makes of a short text: best score first, leftmost on ties."""
        parts = list(s)
        while len(parts) > 1:
            best, at = -INFINITE, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, before: str | None, piece: str) -> float:
        """Weight of ``piece`` after ``before`` (None: after a boundary), remembered."""
        if self.bpe:
            legal = self.merged(piece) == [piece] if before is None else self.merged(before + piece) == [before, piece]
            found = 0.0 if legal else INFINITE
        else:
            found = -self.scores[self.ids[piece]]
        if self.known_pairs >= PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        self.known_pairs += 1
        self.pairs.setdefault(before, {})[self.own[piece]] = found  # the piece's one string, not a copy
        return found

    def shortest(self, s: str) -> list[int]:
        """Ids on the shortest path through the lattice of ``s`` in the tropical semiring.

        At each position the input is composed with the acceptor: an arc for every piece that starts there, and
        one for a character without a piece, that goes by its bytes. The queue is ordered by cost for BPE models, the
        furthest position first among equals (no weight is below zero, so a position that leaves it is settled, and
        positions that wait when the end leaves it are never composed), and by position for unigram ones. Of BPE
        lattices a position has at most one path of finite weight, so its last piece is known and pair weights
        need no more states; unigram weights do not depend on the piece before.
        """
        n, ids, none, step, bpe = len(s), self.ids, {}, self.starts.get, self.bpe
        cost, last = [0.0] + [INFINITE] * n, [(0, None)] * (n + 1)  # last: (start, piece or None for bytes)
        settled, queue = bytearray(n + 1), [(0.0, 0)]
        while queue:
            i = -heappop(queue)[1]
            if i == n:
                break
            if settled[i]:
                continue
            settled[i] = 1
            so_far, before, j, piece = cost[i], last[i][1], i + 1, s[i]
            known = self.pairs.get(before, none).get
            if piece not in ids and so_far - self.worst < cost[j]:
                c = cost[j] = so_far - self.worst
                last[j] = (i, None)
                heappush(queue, (c if bpe else j, -j))
            state = step(piece)
            while state is not None:
                if state >= 0:
                    c = known(piece)
                    c = so_far + (self.weight(before, piece) if c is None else c)
                    if c < cost[j]:
                        cost[j], last[j] = c, (i, piece)
                        heappush(queue, (c if bpe else j, -j))
                if j == n:
                    break
                j += 1
                piece = s[i:j]
                state = step(piece)
        out, j = [], n
        while j:
            i, piece = last[j]
            if piece is not None:
                out.append(ids[piece])
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(s[i:j].encode())]
            else:
                out.append(self.unknown)
            j = i
        return out[::-1]

    def _word(self, s: str) -> bytes:
        """Ids of one input that is not among ``words``, as int32, remembered."""
        found = self.older.get(s)
        if found is None:
            joins, get = self.joins, self.words.get
            if joins.issuperset(map(str.__add__, s, s[1:])):
                found = array("i", self.shortest(s)).tobytes()
            else:  # no piece spans a pair that none contains
                cuts = [0, *[k for k, p in enumerate(map(str.__add__, s, s[1:]), 1) if p not in joins], len(s)]
                found = b"".join([get(p) or self._word(p) for p in [s[i:j] for i, j in zip(cuts, cuts[1:])]])
        if len(self.words) >= CACHE:  # words in use move on to the next generation
            self.older, self.words = self.words, {}
        self.words[s] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        s = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if not self.by_word:
            return np.frombuffer(self.words.get(s) or self._word(s), np.int32)
        get, missing = self.words.get, self._word
        return np.frombuffer(b"".join([get(p) or missing(p) for p in self.inputs(s)]), np.int32)

    def decode(self, ids) -> str:
        t = self.text
        s = b"".join([t[i] for i in ids]).decode("utf-8", "replace")
        return s[1:] if self.prefix and s.startswith(" ") else s


_COMPILED: dict[str, Transducer] = {}


def compiled(model: dict) -> Transducer:
    """The transducer of a model, kept by the worker process across its tasks."""
    if model["key"] not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[model["key"]] = Transducer(model)
    KEPT["sentencepiece"] = _COMPILED.clear
    return _COMPILED[model["key"]]


def _run(shared, at: int, kept: list[int], names: list[str]):
    """The text is column ``at``; the columns ``kept`` go on."""

    def run(batches):
        import pyarrow as pa

        fst = compiled(shared.value)
        for batch in batches:
            for lo, hi, raw in column_slices(batch.column(at), SLICE):
                b, texts = batch.slice(lo, hi - lo), [None if x is None else x.decode() for x in raw]
                ids = [fst.encode(t) for t in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                back = [(t or "").replace(BLANK, " ") == fst.decode(x.tolist()) for t, x in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(sizes), pa.array(back)], names=names)

    return run


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with ids array<int>, n_tokens long and round_trip boolean.

    The model's pieces are broadcast: their number is the vocabulary's size. The text goes to
    the workers once, and comes back only with ``keep_text``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))
    added = ("ids", "n_tokens", "round_trip")
    kept = [c for c in docs.columns if c not in added and (keep_text or c != text)]
    inner = [f"__sp_{i}" for i in range(len(kept))]
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__sp_text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner) if c != text])
    place = {n: i for i, n in enumerate(rows.columns)}
    places = [0 if c == text else place[n] for c, n in zip(kept, inner)]
    kinds = ", ".join(f"{n} {'string' if c == text else docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, inner))
    out = rows.mapInArrow(tidy(_run(shared, 0, places, [*inner, *added]), "sentencepiece"), f"{kinds}{', ' if kinds else ''}ids array<int>, n_tokens long, round_trip boolean")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, inner)], *added)


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """The rows with their text decoded from ``ids`` as the column ``decoded``."""
    shared = rows.sparkSession.sparkContext.broadcast(read_model(model))

    def run(series):
        fst = compiled(shared.value)
        for s in series:
            yield s.map(lambda x: None if x is None else fst.decode(x))

    from typing import Iterator

    import pandas as pd

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn("decoded", F.pandas_udf(run, "string")(F.col(ids)))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
