"""Alignment of two tokenizers' tokens by interval coalescing.

Both tokenizers cut the same bytes (a space and the text) into intervals. All A and B
tokens are sorted by start; the running maximum of their ends (maximum.accumulate) says
how far the tokens so far reach, and a group breaks where a start reaches it, that is,
where tokens of both kinds end. Inside the groups, overlaps are expanded into links.

1. One pass over the texts. A text is cut where a single space stands between two
   characters that are no white space. Neither tokenizer joins across such a place (A's
   pattern takes a space only in front of a word, B has no piece with a blank behind another
   character; both are checked when the files are read, and else texts are not cut), so
   the pieces are aligned on their own, in batches, and remembered in each worker, in two
   generations of up to ``CACHE`` short ones.
2. The pass gives a row per document, with its distinct id pairs and how often each is
   linked, and the task's sums of all pairs, which Spark adds up to corpus-wide counts.
3. With the counts of all pairs and the highest of each B id, the documents' pairs become
   ``n_best`` and ``count_sum``. Counts go out by broadcast while they are counted to be at
   most ``BROADCAST_PAIRS``; else the documents' pairs meet them in an ordinary join.

Defined results. Texts that are null or empty, or whose A or B bytes joined differ from
space and text (a text with the blank mark U+2581, say), have no tokens: zeros and an empty
``groups_sha256``. Strings of special tokens are plain text. Every row is answered, also of
repeated or null ids. An empty table gives an empty table. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, Workspace, table, tidy
from .shingles import column_slices

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
BLANK, CACHE, SHORT, BROADCAST_PAIRS, HELD = "▁", 150_000, 48, 4_000_000, 2_000_000
#: The split pattern that byte-level tokenizer files stand for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
ROWS = "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair long, links long"


def byte_characters() -> dict[str, int]:
    """Byte of each character in a byte-level vocabulary: printable Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A. Its merges are ranked by id where ids follow the merges, as is usual."""

    def __init__(self, data: bytes):
        import tiktoken

        model = json.loads(data)
        own = byte_characters()
        vocabulary = model["model"]["vocab"]
        special = {t["content"] for t in model.get("added_tokens", [])}
        bytes_of = {i: bytes(own[c] for c in t) for t, i in vocabulary.items() if t not in special}
        merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        step = model.get("pre_tokenizer") or {}
        self.in_order = merged == sorted(merged) and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True) and not model.get("normalizer")
        self.size = max(bytes_of) + 1
        self.bytes = [bytes_of.get(i, b"") for i in range(self.size)]
        if self.in_order:
            ranks = {t: i for i, t in bytes_of.items()}
            self.ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True

    def encode(self, text: str) -> list[int]:
        if self.in_order and len(text) < 100_000:
            return self.ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B, which puts a space in front of every text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.size = len(names)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.by_word = not any(BLANK in p.lstrip(BLANK) for p in names)

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text) if text else []


def coalesced(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Group number of all A and then all B tokens, intervals that cover the same bytes."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([[0], a_ends[:-1], [0], b_ends[:-1]]) if len(ends) else ends
    kind = np.repeat([0, 1], [len(a_ends), len(b_ends)])
    order = np.lexsort((kind, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order[1:]] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    return group


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of A, of B) of all links, in order of A."""
    a_starts, b_starts = (np.concatenate([[0], e[:-1]]) for e in (a_ends, b_ends))
    first, last = np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left")
    many = last - first
    return np.repeat(np.arange(len(a_ends)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)


class Aligner:
    """Aligns texts piece by piece; ``of(texts)`` gives one entry a text."""

    def __init__(self, data_a: bytes, data_b: bytes):
        self.a, self.b = ByteLevel(data_a), Pieces(data_b)
        self.lengths = [np.array([len(t) for t in m.bytes], np.int64) for m in (self.a, self.b)]
        self.by_word = self.a.in_order and self.b.by_word
        # An id and what follows it: "," inside a run, "|" behind A's run, ";" behind B's.
        self.written = np.array([f"{i}{end}" for m, ends in ((self.a, ",|"), (self.b, ",;")) for i in range(m.size) for end in ends], object)
        self.seen: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def aligned(self, pieces: list[str]) -> list[tuple | None]:
        """(groups as text, n_a, n_b, n_groups, pair keys as int64) of each piece behind a
        space, all encoded at once; None if its bytes are not met."""
        text = " ".join(["", *pieces])
        whole, coded = text.encode(), (self.a.encode(text), self.b.encode(text[1:]))
        if any(b"".join(map(m.bytes.__getitem__, ids)) != whole for m, ids in zip((self.a, self.b), coded)):
            half = len(pieces) // 2
            return [*self.aligned(pieces[:half]), *self.aligned(pieces[half:])] if half else [None]
        a, b = (np.array(ids, np.int64) for ids in coded)
        a_ends, b_ends = (np.cumsum(n[ids]) for n, ids in zip(self.lengths, (a, b)))
        group = coalesced(a_ends, b_ends)
        kind, code = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([2 * a, 2 * (b + self.a.size)])
        order = np.argsort(2 * group + kind, kind="stable")
        run = (2 * group + kind)[order]
        written = self.written[code[order] + np.append(run[1:] != run[:-1], True)].tolist()
        x, y = overlaps(a_ends, b_ends)
        keys = (a[x] * self.b.size + b[y]).tobytes()
        cuts = np.cumsum([len(p.encode()) + 1 for p in pieces])
        a_cut, b_cut = (np.searchsorted(e, cuts, side="right") for e in (a_ends, b_ends))
        g_cut, link_cut = group[a_cut - 1] + 1, np.searchsorted(x, a_cut)
        many = [np.diff(c, prepend=0).tolist() for c in (a_cut, b_cut, g_cut)]
        ends, links = (a_cut + b_cut).tolist(), (8 * link_cut).tolist()
        return [("".join(written[i:j])[:-1], n_a, n_b, n_g, keys[k:m]) for i, j, n_a, n_b, n_g, k, m in zip([0, *ends], ends, *many, [0, *links], links)]

    def _learn(self, words: list[str], into: dict) -> None:
        edges = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]  # first or last of a text
        for w in edges:
            into[w] = self.aligned([w])[0]
        odd = set(edges)
        rest = [w for w in words if w not in odd]
        for lo in range(0, len(rest), 2_000):
            part = rest[lo : lo + 2_000]
            into.update(zip(part, self.aligned(part)))

    def of(self, texts: list[str | None]) -> list[tuple | None]:
        """(groups, n_a, n_b, n_groups, keys) of each text; None: no tokens."""
        parts = [[] if not t else _CUT.split(t) if self.by_word else [t] for t in texts]
        words = set().union(*parts)
        new = [w for w in words if w not in self.seen]
        self.seen |= {w: self.older[w] for w in new if w in self.older}
        new = [w for w in new if w not in self.older]
        self._learn([w for w in new if len(w) <= SHORT], self.seen)
        long: dict[str, tuple] = {}
        for w in new:
            if len(w) > SHORT:
                self._learn([w], long)
        get = (self.seen | long if long else self.seen).__getitem__
        out = []
        for p in parts:
            found = list(map(get, p))
            if not found or None in found:
                out.append(None)
            else:
                groups, n_a, n_b, n_groups, keys = zip(*found)
                out.append((";".join(groups), sum(n_a), sum(n_b), sum(n_groups), b"".join(keys)))
        if len(self.seen) > CACHE:
            self.older, self.seen = self.seen, {}
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(models: tuple[bytes, bytes]) -> Aligner:
    """The aligner of two files, kept by the worker process across its tasks."""
    key = tuple(hashlib.sha256(m).digest() for m in models)
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(*models)
    KEPT["alignment"] = _ALIGNERS.clear
    return _ALIGNERS[key]


def summed(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their summed times."""
    keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate(times))
    return keys, total


def _align(shared):
    """Rows (id, row, text) to document rows, and at last rows (pair, links) of the task."""

    def run(batches):
        import pyarrow as pa

        aligner, held, size, base = _aligner(shared.value), ([], []), 0, 0
        names = ["id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "pair", "links"]

        def totals(keys, links):
            for lo in range(0, len(keys), 1 << 17):
                part = [pa.array(x[lo : lo + (1 << 17)]) for x in (keys, links)]
                n = len(part[0])
                none = [pa.nulls(n, t) for t in [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]]
                yield pa.RecordBatch.from_arrays([*none, *part], names=names)

        for b in batches:
            for lo, hi, raw in column_slices(b.column(2)):
                found = aligner.of([None if x is None else x.decode() for x in raw])
                n, keys, times = hi - lo, [], []
                for e in found:
                    k, c = np.unique(np.frombuffer(e[4] if e else b"", np.int64), return_counts=True)
                    keys.append(k)
                    times.append(c.astype(np.int64))
                count = lambda i: pa.array([e[i] if e else 0 for e in found], pa.int64())
                links = pa.array([len(e[4]) // 8 if e else 0 for e in found], pa.int64())
                digest = pa.array([hashlib.sha256(e[0].encode()).hexdigest() if e else "" for e in found])
                packed = [pa.array([np.diff(k, prepend=0).astype(np.uint32).tobytes() for k in keys], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for c in times], pa.binary())]
                none = [pa.nulls(n, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), count(1), count(2), count(3), links, digest, *packed, *none], names=names)
                held[0].extend(keys)
                held[1].extend(times)
                size += sum(map(len, keys))
                if size - base > HELD:
                    k, c = summed(*held)
                    held, base, size = ([k], [c]), len(k), len(k)
                    if base > HELD:  # more different pairs than a task holds: Spark adds them up
                        yield from totals(k, c)
                        held, base, size = ([], []), 0, 0
        if held[0]:
            yield from totals(*summed(*held))

    return run


def _scored(shared):
    """Document rows to (columns..., n_best, count_sum) by the broadcast counts."""

    def run(batches):
        import pyarrow as pa

        keys, links, best = shared.value
        for b in batches:
            found = []
            for pairs, times in zip(b.column(6).to_pylist(), b.column(7).to_pylist()):
                at = np.searchsorted(keys, np.cumsum(np.frombuffer(pairs, np.uint32).astype(np.int64)))
                times = np.frombuffer(times, np.uint32).astype(np.int64)
                found.append((int(times[best[at]].sum()), int((times * links[at]).sum())))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=[*b.schema.names[:6], "n_best", "count_sum"])

    return run


def _spread(batches):
    """Document rows (row, pairs, times) to rows (row, pair, times)."""
    import pyarrow as pa

    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            pairs = [np.cumsum(np.frombuffer(p, np.uint32).astype(np.int64)) for p in part.column(1).to_pylist()]
            times = [np.frombuffer(t, np.uint32).astype(np.int64) for t in part.column(2).to_pylist()]
            rows = np.repeat(part.column(0).to_numpy(), [len(p) for p in pairs])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times))], names=["row", "pair", "times"])


def align(docs: DataFrame, text: str = "text", key: str = "doc_id", model_a: str = MODEL_A, model_b: str = MODEL_B, broadcast_pairs: int = BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """One row per input row (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256),
    and the table (id_a, id_b, links, best) of all linked id pairs."""
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "align")
    models = []
    for path in (model_a, model_b):
        with open(path, "rb") as f:
            models.append(f.read())
    size_b = Pieces(models[1]).size
    shared = spark.sparkContext.broadcast(tuple(models))  # two vocabularies
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    found = ws.write(rows.mapInArrow(tidy(_align(shared), "alignment"), ROWS), "aligned", compression="zstd")
    sums = found.filter("pair is not null").groupBy("pair").agg(F.sum("links").alias("links")).withColumn("id_b", F.col("pair") % size_b)
    sums = ws.write(sums, "sums")
    top = sums.groupBy("id_b").agg(F.max("links").alias("most"))  # one row for each B id, a vocabulary
    counts = ws.write(sums.join(F.broadcast(top), "id_b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "counts")
    each = found.filter("row is not null")
    kept = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        t = counts.orderBy("pair").toArrow()
        known = spark.sparkContext.broadcast(tuple(t.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "links", "best")))
        out = each.select(*kept, "pairs", "times").mapInArrow(tidy(_scored(known)), "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    else:
        spread = each.select("row", "pairs", "times").mapInArrow(_spread, "row long, pair long, times long")
        scores = spread.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
        out = each.select("row", *kept).join(scores, "row", "left").na.fill(0, ["n_best", "count_sum"])
    out = ws.write(out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "result")
    ws.drop("aligned", "sums")
    return out, counts.select(F.floor(F.col("pair") / size_b).cast("long").alias("id_a"), (F.col("pair") % size_b).alias("id_b"), "links", "best")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))[0]
