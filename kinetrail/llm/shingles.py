"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A set holds
the distinct k-word shingles; a text with fewer words has one shingle, the whole
sequence; a text without words has none. Two different shingles of a pair of texts
share a hash with a chance of about 1e-14, which is the method's only error.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SLICE_BYTES = 1 << 20


def slices(texts: list[bytes | None], limit: int = SLICE_BYTES):
    """Ranges of texts of about ``limit`` bytes, at least one text each."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def column_slices(column, limit: int = SLICE_BYTES):
    """(first, end, texts as bytes) of an Arrow column, about ``limit`` bytes at a time.

    Only one slice becomes Python objects, however large the batch is.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right")))
        yield lo, hi, raw.slice(lo, hi - lo).to_pylist()
        lo = hi


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges, ends included."""
    inside = np.zeros(256, bool)
    for lo, hi in ranges:
        inside[lo : hi + 1] = True
    return inside


WORDS = ~byte_table((9, 13), (32, 32))
LOWER = np.where(byte_table((65, 90)), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def word_hashes(texts: list[bytes | None], inside: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``inside`` bytes, A-Z lower-cased, and runs per text.

    The blank, which stands between texts here, must not be inside.
    """
    data = LOWER[np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8)]
    within = inside[data]
    begins = np.flatnonzero(within & ~np.concatenate([[False], within[:-1]]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(within)
    heads = np.searchsorted(at, begins)
    lengths = np.diff(np.append(heads, len(at)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) - 1, BASE)]), dtype=np.uint64)
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    word = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers[place], heads)
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    owner = np.searchsorted(np.cumsum(sizes), begins, side="right")
    return mixed(word + lengths.astype(np.uint64) * STEP), owner, np.bincount(owner, minlength=len(texts))


def shingle_hashes(texts: list[bytes | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every shingle in order of place, repeats included."""
    word, owner, count = word_hashes(texts)
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = word.copy()
    n = max(0, len(word) - k + 1)
    for i in range(1, k):
        hashes[:n] = hashes[:n] * STEP + word[i : i + n]
    whole = np.flatnonzero(np.arange(len(word)) + k <= np.cumsum(count)[owner])
    few = np.flatnonzero((count > 0) & (count < k))
    own = np.zeros(len(few), np.uint64)
    starts = (np.cumsum(count) - count)[few]
    for i in range(k - 1):
        more = count[few] > i
        own = np.where(more, own * STEP + word[np.minimum(starts + i, len(word) - 1)], own)
    own += count[few].astype(np.uint64) * BASE
    doc = np.concatenate([owner[whole], few])
    return doc, mixed(np.concatenate([hashes[whole], own]))


def shingle_sets(texts: list[bytes | None], k: int = 5, rank=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash), sorted by text, ``rank(hash)`` and hash."""
    doc, h = shingle_hashes(texts, k)
    order = np.lexsort((h, doc) if rank is None else (h, rank(h), doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]
