"""Suffix-array deduplication of byte strings that repeat across documents.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a document
with a smaller id. Shards are cut by content, so that equal strings meet:

1. Every ``LENGTH``-byte window names an anchor, the least hash among its ``GRAM``-byte
   grams (winnowing). The anchor depends on the window's bytes alone, so equal
   windows have equal anchors, and one anchor serves a run of windows.
2. Anchor hashes are sent to buckets by hash range, once or twice per slice of
   documents (twice if two documents of the slice have it), and those that occur
   in two documents set a bit of a bitmap. Its size follows the input up to
   ``MOST_BITS``; a bit set by chance costs traffic only.
3. Runs of windows with such anchors are sent, as the bytes that they cover, to
   shards by anchor hash. Equal byte runs within a slice are sent once: copies in
   larger documents of the slice are settled on the map side.
4. A shard sorts its suffixes in numpy by Larsson-Sadakane refinement: by words of 8
   bytes, then only unsorted groups by the rank of the suffix h bytes on, h
   doubling, until whole runs are sorted. Kasai's pass, in step over
   all runs, gives common prefixes; neighbours with LENGTH or more in common are
   one string, whose smallest document stays. A bucket has several shards if it is
   larger than ``SHARD_BYTES``; where an anchor's runs lie in two shards, their
   sorted strings are merged by binary search.
5. The removed windows of each document are joined to its text.

Defined results. Null and empty texts have no bytes: the hash is that of nothing.
Texts shorter than LENGTH lose nothing. Rows repeated with one id do not remove
from each other. Rows with a null id are neither searched nor compared. Very long
texts are worked on in overlapping pieces. Only key and text are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mixed, table

LENGTH, GRAM = 50, 24
SLICE_BYTES, PIECE_BYTES, SHARD_BYTES, BUCKET_BYTES, MOST_BITS, BROADCAST_IDS = 1 << 20, 1 << 22, 1 << 19, 8 << 20, 30, 1_000_000
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
RUN = "kind int, bucket long, docs binary, meta binary, data binary"
META = np.dtype([("doc", "<u4"), ("start", "<u4"), ("anchor", "<u4"), ("windows", "u1")])
GONE = "id long, version long, starts binary, masks binary"


def pieces(texts: list[bytes | None], piece: int, slice_bytes: int):
    """Slices of (row, offset, bytes); pieces of a long text overlap by LENGTH - 1 bytes."""
    own, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t or b"") - LENGTH + 1), piece):
            part = t[at : at + piece + LENGTH - 1]
            if size and size + len(part) > slice_bytes:
                yield own
                own, size = [], 0
            own.append((i, at, part))
            size += len(part)
    if own:
        yield own


def runs(own: list[tuple[int, int, bytes]]):
    """(data, row, start in text, start in data, windows, anchor hash) of one slice's runs."""
    data = np.frombuffer(b"".join([p for _, _, p in own]), np.uint8)
    sizes = np.array([len(p) for _, _, p in own], np.int64)
    h, power, span = data.astype(np.uint64) + np.uint64(1), np.array([BASE]), 1
    while span < 8:
        h, power, span = h[:-span] * power + h[span:], power * power, 2 * span
    eight, by_eight = h, power
    h = h[:-8] * power + h[8:]
    h = mixed(h[:-8] * by_eight + eight[16 : 16 + len(h) - 8])  # GRAM = 24 bytes
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    width, wide = LENGTH - GRAM + 1, 1
    while 2 * wide <= width:
        key, wide = np.minimum(key[:-wide], key[wide:]), 2 * wide
    key = np.minimum(key[: len(key) - (width - wide)], key[width - wide :])
    anchor = (low - (key & low)).astype(np.int64)
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(own)), sizes)[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[piece])
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (piece[at[1:]] != piece[at[:-1]])
    heads = np.flatnonzero(new)
    first = at[heads]
    rows, offsets = np.array([r for r, _, _ in own]), np.array([o for _, o, _ in own])
    p = piece[first]
    evenly = mixed(h[anchor[first]] + BASE)  # least hashes are small ones: mixed again, they fill all buckets
    return data, rows[p], first - (ends - sizes)[p] + offsets[p], first, np.diff(np.append(heads, len(at))), evenly


def _raw(column):
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def _anchors(log_buckets: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for own in pieces(_raw(b.column(0)), PIECE_BYTES, SLICE_BYTES):
                _, row, _, _, _, h = runs(own)
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                again = np.zeros(len(h), bool)
                again[1:] = ~new[1:] & (row[1:] != row[:-1])
                group = np.cumsum(new) - 1
                twice = np.zeros(group[-1] + 1, bool)
                twice[group[again]] = True
                sent = np.sort(np.concatenate([h[new], h[new][twice]]))
                bucket = (sent >> np.uint64(64 - log_buckets)).astype(np.int64) if log_buckets else np.zeros(len(sent), np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cuts]), pa.array([sent[lo:hi].tobytes() for lo, hi in zip(cuts, np.append(cuts[1:], len(sent)))], pa.binary())], names=["bucket", "hashes"]
                )

    return run


def _bits(log_buckets: int, log_bits: int):
    """Per bucket: its part of the bitmap, and how often its repeated anchors were sent."""

    def run(batches):
        import pyarrow as pa

        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(k, []).append(v)
        for k, parts in held.items():
            h = np.sort(np.frombuffer(b"".join(parts), np.uint64))
            same = h[1:] == h[:-1]
            often = h[1:][same]
            own = ((often >> np.uint64(64 - log_bits)) & np.uint64((1 << (log_bits - log_buckets)) - 1)).astype(np.int64)
            bits = np.zeros(1 << (log_bits - log_buckets), np.uint8)
            bits[own] = 1
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([2 * len(often)])], names=["bucket", "bits", "sent"])

    return run


def _words(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Bytes of runs, padded with zeros to ``width`` (a multiple of 8), as big-endian words."""
    out, inside = np.empty((len(first), width // 8), np.uint64), np.arange(width, dtype=np.int32)[None, :]
    for k in range(0, len(first), 8192):
        at = np.minimum(first[k : k + 8192, None].astype(np.int32) + inside, len(data) - 1)
        m = np.where(inside < sizes[k : k + 8192, None], data[at], 0).astype(np.uint8)
        out[k : k + 8192] = m.view(">u8")
    return out


WIDTH = -(-(2 * LENGTH - GRAM) // 8) * 8  # the longest run: LENGTH - GRAM + 1 windows


def _digests(words: np.ndarray) -> np.ndarray:
    d = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        d = mixed(d * STEP + words[:, j] + np.uint64(j))
    return d


def _send(shared, log_bits: int, log_buckets: int):
    def run(batches):
        import pyarrow as pa

        bitmap = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            ids, versions, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), _raw(b.column(2))
            for own in pieces(texts, PIECE_BYTES, SLICE_BYTES):
                data, row, start, first, windows, h = runs(own)
                bit = h >> np.uint64(64 - log_bits)
                keep = ((bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                row, start, first, windows, h = (x[keep] for x in (row, start, first, windows, h))
                if not len(row):
                    continue
                digest = _digests(_words(data, first, windows + LENGTH - 1, WIDTH)) ^ windows.astype(np.uint64)
                order = np.lexsort((ids[row], digest))
                row, start, first, windows, h, digest = (x[order] for x in (row, start, first, windows, h, digest))
                new = np.ones(len(row), bool)
                new[1:] = digest[1:] != digest[:-1]
                least = ids[row][np.flatnonzero(new)][np.cumsum(new) - 1]
                settled = ids[row] > least
                out = []
                for kind, pick in ((1, settled), (0, ~settled)):
                    at = np.flatnonzero(pick)
                    bucket = (h[at] >> np.uint64(64 - log_buckets)).astype(np.int64) if log_buckets else np.zeros(len(at), np.int64)
                    if kind:
                        bucket[:] = zlib.crc32(own[0][2][:64]) % (1 << log_buckets)
                    at, bucket = at[np.argsort(bucket, kind="stable")], np.sort(bucket, kind="stable")
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    for lo, hi in zip(cuts, np.append(cuts[1:], len(at))):
                        e = at[lo:hi]
                        rows, doc = np.unique(row[e], return_inverse=True)
                        meta = np.empty(len(e), META)
                        meta["doc"], meta["start"], meta["anchor"], meta["windows"] = doc, start[e], (h[e] & np.uint64(0xFFFFFFFF)), windows[e]
                        size = windows[e] + LENGTH - 1
                        ragged = b"" if kind else data[np.repeat(first[e] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
                        out.append((kind, int(bucket[lo]), np.stack([ids[rows], versions[rows]], 1).tobytes(), meta.tobytes(), ragged))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["kind", "bucket", "docs", "meta", "data"])

    return run


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` in order (Larsson-Sadakane).

    ends: for each position the end of its run, beyond which bytes count as zero.
    Equal suffixes come by position, on which Kasai's pass relies.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    left = ends - np.arange(n)
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    near = np.flatnonzero(left < 8)
    word[near] &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - left[near].astype(np.uint64)))) - np.uint64(1))
    order = np.argsort(word)
    new = np.ones(n, bool)
    new[1:] = word[order[1:]] != word[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1  # 0 is the end of a run
    h, depth = 8, int(left.max(initial=0))
    while h < depth:
        more = np.ones(n, bool)
        more[:-1] = new[1:]
        slots = np.flatnonzero(~(new & more))  # unsorted groups only
        if not len(slots):
            break
        at = order[slots]
        on = np.where(h < left[at], rank[np.minimum(at + h, n - 1)], 0)
        by = np.argsort(rank[at] * (n + 1) + on)
        at, on = at[by], on[by]
        group = rank[at]
        order[slots] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = (on[1:] != on[:-1]) | (group[1:] != group[:-1])
        new[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        h *= 2
    more = np.ones(n, bool)
    more[:-1] = new[1:]
    slots = np.flatnonzero(~(new & more))
    at = order[slots]
    order[slots] = at[np.argsort(rank[at] * (n + 1) + at)]
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Kasai: bytes in common with the suffix before, up to ``most``; runs go in step."""
    n = len(data)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    ends = np.repeat(starts + sizes, sizes)
    lcp, h = np.zeros(n, np.int64), np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        lane = np.flatnonzero(sizes > t)
        at = starts[lane] + t
        to = before[at]
        own = np.maximum(h[lane] - 1, 0)
        own[to < 0] = 0
        room = np.where(to < 0, 0, np.minimum(np.minimum(ends[at] - at, ends[to] - to), most))
        own = np.minimum(own, room)
        going = np.flatnonzero(own < room)
        while len(going):
            equal = data[at[going] + own[going]] == data[to[going] + own[going]]
            going = going[equal]
            own[going] += 1
            going = going[own[going] < room[going]]
        lcp[at] = own
        h[lane] = own
    return lcp[order]


def find_strings(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Binary search of rows of words in sorted rows of words; -1 if absent."""
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        probe = keys[np.minimum(mid, len(keys) - 1)]
        differ = probe != wanted
        where = differ.argmax(1)
        less = differ.any(1) & (np.take_along_axis(probe, where[:, None], 1) < np.take_along_axis(wanted, where[:, None], 1))[:, 0]
        go = lo < hi
        lo = np.where(go & less, mid + 1, lo)
        hi = np.where(go & ~less, mid, hi)
    at = np.minimum(lo, len(keys) - 1)
    return np.where((lo < len(keys)) & (keys[at] == wanted).all(1), at, -1)


def shard_minima(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, windows: np.ndarray, docs: np.ndarray):
    """Smallest document of every window's string: (run, window) in order of runs.

    Also the sorted distinct strings: position of one of them, class of each window.
    """
    order = suffix_array(data, np.repeat(starts + sizes, sizes))
    lcp = common_prefixes(data, order, starts, sizes)
    run = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    is_window = place < windows[run]
    cls = np.cumsum(lcp < LENGTH) - 1
    pick = is_window[order]
    own, cls = order[pick], cls[pick]
    _, cls = np.unique(cls, return_inverse=True)
    least = np.full(cls.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, cls, docs[run[own]])
    sample = np.zeros(len(least), np.int64)
    sample[cls] = own
    of = np.zeros(len(data), np.int64)
    of[own] = cls
    return least, sample, of[is_window]


def _settle(shard_bytes: int):
    def run(batches):
        import pyarrow as pa

        packs: dict[int, list] = {}
        for b in batches:
            for kind, bucket, docs, meta, data in zip(*[c.to_pylist() for c in b.columns]):
                docs, meta = np.frombuffer(docs, np.int64).reshape(-1, 2), np.frombuffer(meta, META)
                if kind:
                    yield gone(docs, meta, (np.int64(1) << meta["windows"].astype(np.int64)) - 1, pa)
                else:
                    packs.setdefault(bucket, []).append((docs, meta, np.frombuffer(data, np.uint8)))
        for bucket in list(packs):
            own = packs.pop(bucket)
            docs = np.concatenate([d for d, _, _ in own])
            shift = np.repeat(np.cumsum([0] + [len(d) for d, _, _ in own[:-1]]), [len(m) for _, m, _ in own])
            meta = np.concatenate([m for _, m, _ in own])
            meta["doc"] += shift.astype(np.uint32)
            masks = settle(docs[:, 0], meta, np.concatenate([x for _, _, x in own]), shard_bytes)
            some = masks != 0
            if some.any():
                yield gone(docs, meta[some], masks[some], pa)

    def gone(docs, meta, masks, pa):
        order = np.argsort(meta["doc"], kind="stable")
        meta, masks = meta[order], masks[order]
        cuts = np.flatnonzero(np.diff(meta["doc"].astype(np.int64), prepend=-1))
        ends = np.append(cuts[1:], len(meta))
        d = docs[meta["doc"][cuts].astype(np.int64)]
        starts, masks = meta["start"].astype("<u4"), masks.astype("<u4")
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), cut(starts), cut(masks)], names=["id", "version", "starts", "masks"])

    return run


def settle(ids: np.ndarray, meta: np.ndarray, data: np.ndarray, shard_bytes: int) -> np.ndarray:
    """Removed windows of each run, as bits: those whose string has a smaller document."""
    windows = meta["windows"].astype(np.int64)
    sizes = windows + LENGTH - 1
    first = np.cumsum(sizes) - sizes
    owner = ids[meta["doc"].astype(np.int64)]
    digest = _digests(_words(data, first, sizes, WIDTH)) ^ windows.astype(np.uint64)
    order = np.lexsort((owner, digest, meta["anchor"]))
    new = np.ones(len(order), bool)
    new[1:] = (digest[order[1:]] != digest[order[:-1]]) | (meta["anchor"][order[1:]] != meta["anchor"][order[:-1]])
    heads = order[new]  # distinct runs, each with its smallest document
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    size, anchor = sizes[heads], meta["anchor"][heads]
    shard = (np.cumsum(size) - size) // shard_bytes
    minima, offset = np.zeros(int(windows[heads].sum()), np.int64), np.cumsum(windows[heads]) - windows[heads]
    chains = []  # shards that share an anchor with the one before: (strings, minima, where)
    for s in np.unique(shard):
        lo, hi = np.searchsorted(shard, [s, s + 1])
        n = size[lo:hi]
        starts = np.cumsum(n) - n
        own = data[np.repeat(first[heads[lo:hi]] - starts, n) + np.arange(n.sum())]
        least, sample, of = shard_minima(own, starts, n, windows[heads[lo:hi]], owner[heads[lo:hi]])
        where = slice(int(offset[lo]), int(offset[lo]) + len(of))
        shares = lambda i, j: 0 <= i and j < len(anchor) and anchor[i] == anchor[j]
        if not shares(lo - 1, lo):
            chains = []
        minima[where] = least[of]
        if chains or shares(hi - 1, hi):
            strings = _words(own, sample, np.full(len(sample), LENGTH), -(-LENGTH // 8) * 8)
            for other, other_least, other_of, other_where in chains:
                at = find_strings(other, strings)
                hit = np.flatnonzero(at >= 0)
                both = np.minimum(least[hit], other_least[at[hit]])
                least[hit] = both
                other_least[at[hit]] = both
                minima[other_where] = other_least[other_of]
            minima[where] = least[of]
            chains.append((strings, least, of, where))
    masks = np.zeros(len(meta), np.int64)
    for j in range(int(windows.max(initial=0))):
        has = np.flatnonzero(windows > j)
        masks[has] |= (minima[offset[group[has]] + j] < owner[has]).astype(np.int64) << j
    return masks


def removed_bytes(n: int, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which of n bytes the removed windows cover."""
    edge = np.zeros(n + 1, np.int64)
    for j in range(LENGTH - GRAM + 1):
        x = starts[(masks >> j) & 1 == 1] + j
        np.add.at(edge, x, 1)
        np.add.at(edge, x + LENGTH, -1)
    return np.cumsum(edge[:n]) > 0


def _cut(batches):
    import pyarrow as pa

    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            rows = []
            for i, text, starts, masks in zip(part.column(0).to_pylist(), _raw(part.column(1)), part.column(2).to_pylist(), part.column(3).to_pylist()):
                data = np.frombuffer(text or b"", np.uint8)
                spans, kept = [], data
                if starts:
                    gone = removed_bytes(len(data), np.frombuffer(b"".join(starts), "<u4").astype(np.int64), np.frombuffer(b"".join(masks), "<u4").astype(np.int64))
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
                    spans, kept = edges.reshape(-1, 2).tolist(), data[~gone]
                rows.append((i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def _log2_above(x: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, x)))))


def suffix_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, spans [[start, end]], kept_sha256."""
    spark = docs.sparkSession
    ws = Workspace(spark, "suffix")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = size * 2 / (LENGTH - GRAM + 2)
    log_bits = min(MOST_BITS, max(16, _log2_above(4 * anchors)))
    parts = min(log_bits - 3, _log2_above(max(2 * spark.sparkContext.defaultParallelism, anchors * 8 / BUCKET_BYTES)))
    whole = rows.filter("id is not null")
    found = ws.write(whole.select("text").mapInArrow(_anchors(parts), "bucket long, hashes binary").repartition(1 << parts, "bucket").mapInArrow(_bits(parts, log_bits), "bucket long, bits binary, sent long"), "bits")
    bitmap, sent = bytearray(1 << (log_bits - 3)), 0
    for r in found.toLocalIterator():  # at most 2 ** MOST_BITS bits
        at = r["bucket"] << (log_bits - 3 - parts)
        bitmap[at : at + len(r["bits"])] = r["bits"]
        sent += r["sent"]
    shared = spark.sparkContext.broadcast(bytes(bitmap))
    shards = _log2_above(max(2 * spark.sparkContext.defaultParallelism, sent * WIDTH / BUCKET_BYTES))
    cut = whole.select("id", "version", "text").mapInArrow(_send(shared, log_bits, shards), RUN).repartition(1 << shards, "bucket")
    gone = ws.write(cut.mapInArrow(_settle(shard_bytes), GONE), "gone")
    lists = gone.groupBy("id", "version").agg(F.collect_list("starts").alias("starts"), F.collect_list("masks").alias("masks"))  # bounded by a text's length
    ids = gone.select("id").distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    none = F.lit(None).cast("array<binary>")
    if few:  # texts that lose nothing are not moved
        rest = rows.join(F.broadcast(ids), "id", "left_anti").select("id", "text", none.alias("starts"), none.alias("masks"))
        rows = rows.join(F.broadcast(ids), "id", "left_semi")
    joined = rows.join(lists, ["id", "version"], "left").select("id", "text", "starts", "masks")
    if few:
        joined = joined.unionByName(rest)
    out = joined.mapInArrow(_cut, "id long, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
