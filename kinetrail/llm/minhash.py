"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's signature has ``COORDINATES`` coordinates; each is the least value of its shingles
under one hash function, so two documents collide in a coordinate with a chance of their Jaccard
similarity. Documents with at least ``MATCHES`` collisions are candidates; candidates link if
their full sets do.

1. Signatures. One pass gives each row its set's size, digests, signature and parity bitmap.
   Equal sets are one node from here on. The texts are not read again but for verification.
2. Inverted lists. A node is posted under coordinate-value pairs. Two signatures with m
   collisions share one of their first COORDINATES - m + 1 pairs in any common order, so only
   these prefixes are posted, rare pairs first: pairs are ordered by a fixed table of counters,
   and the values that many documents share stay out of the prefixes.
3. Merging. In each list the shortest set is the hub of those of fitting size, and proposes one
   pair a member. A proposed pair's collisions are counted along both signatures in steps,
   which skip the rest of a pair as soon as its remaining coordinates can't reach MATCHES.
4. What reaches MATCHES, and differs in few enough bits of the bitmaps (a bound from below on
   the sets' difference), is verified once on the full shingle sets of its texts. Links give
   components. Lists that touch several components are opened: first each member's closest partner
   in another component, then all pairs across components are counted and verified. A pair that
   meets in several lists is answered in one of them, its home, which both signatures tell.

With similarity 0.8, fewer than 48 of 96 coordinates collide with a chance below 1e-9 a pair,
and of pairs above 0.8 still less; this, and two shingles with one hash (2**-64), are the only
errors. A reported link is always true, for full sets confirm it.

Defined results. Null, empty and blank texts have no shingle, no link and component_id =
doc_id. Texts of fewer than ``k`` words have one shingle, the whole sequence. Every row counts
with its own text, also where an id repeats; equal ids alone do not link, and ``kept`` says whether
the id is its component's. Rows with a null id link with nothing, have a null component and are
kept. An empty table gives an empty table. Only key and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mixed, table, tidy
from .ngram_join import BUCKET_BYTES, CELLS, CHUNKS, PACK, POSTING, Bitmaps, Names, Order, _lists, bitmaps, cells_of, frequencies, grouped, linked_components, packs, permits, tallied, with_components
from .shingles import STEP, column_slices, shingle_sets

K, PERCENT, COORDINATES, MATCHES, STRIDE = 4, 80, 96, 48, 16
WIDTH = 4 * COORDINATES
SETS = "id long, n int, node long, second long, bits binary"
#: Odd multipliers of the hash functions; a shingle's value is the upper half of the product.
FACTORS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def signatures(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) uint32; rows (doc, h) are sorted by doc. Texts without shingles have zeros."""
    out = np.zeros((len(n), COORDINATES), np.uint32)
    full = np.flatnonzero(n)
    if len(full):
        starts = (np.cumsum(n) - n)[full]
        for c, factor in enumerate(FACTORS):
            out[full, c] = np.minimum.reduceat(((h * factor) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def pair_hashes(signature: np.ndarray) -> np.ndarray:
    """A hash of every coordinate-value pair."""
    return mixed(signature.astype(np.uint64) + (np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32)))


def collisions(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, matches: int) -> np.ndarray:
    """Collisions of signatures x and y, or less than ``matches`` where they can't reach it."""
    count, alive = np.zeros(len(x), np.int64), np.arange(len(x))
    for c in range(0, COORDINATES, STRIDE):
        part = slice(c, c + STRIDE)
        count[alive] += (left[x[alive], part] == right[y[alive], part]).sum(1)
        alive = alive[count[alive] + COORDINATES - min(c + STRIDE, COORDINATES) >= matches]  # skip what can't reach it
    return count


def prefix_pairs(h: np.ndarray, order: Order, length: int) -> np.ndarray:
    """Which coordinates of signatures (their pair hashes) are among the rarest ``length``."""
    inside = np.zeros(h.shape, bool)
    np.put_along_axis(inside, np.lexsort((h, order.rank(h)), axis=1)[:, :length], True, 1)
    return inside


class CollisionFilters:
    """What a pair must meet before its texts are read: fitting sizes and enough collisions."""

    def __init__(self, percent: int, matches: int = MATCHES, shared=None):
        self.percent, self.matches, self.shared, self.length = percent, matches, shared, COORDINATES - matches + 1

    def place(self, part: np.ndarray, n: np.ndarray) -> np.ndarray:
        return part

    def may_link(self, nx, ny, x, y):
        return np.maximum(nx, ny) * self.percent <= np.minimum(nx, ny) * 100

    def compared(self, n: np.ndarray, raw: list[bytes]):
        own, bits, matches = _stacked(raw), Bitmaps(n, [r[WIDTH:] for r in raw]), self.matches
        keys, inside = None, None

        def at_home(x, y, token):
            """Whether the list is the least of all lists in which both are posted."""
            nonlocal keys, inside
            if keys is None:
                h = pair_hashes(own)
                keys, inside = (h >> np.uint64(8)).view(np.int64), prefix_pairs(h, Order(self.shared.value), self.length)
            none = np.iinfo(np.int64).max
            both = (own[x] == own[y]) & inside[x] & inside[y]
            return np.where(both, keys[x], none).min(1) == token

        def run(x, y, token=None):
            count = np.zeros(len(x), np.int64)
            for k in range(0, len(x), 1 << 15):
                part = slice(k, k + (1 << 15))
                count[part] = collisions(own, own, x[part], y[part], matches)
            ok = (count >= matches) & self.may_link(n[x], n[y], 0, 0)
            left = np.flatnonzero(ok)
            ok[left] = permits(n[x[left]], n[y[left]], bits.differ(x[left], y[left]), self.percent)
            if token is not None:
                left = np.flatnonzero(ok)
                for k in range(0, len(left), 1 << 15):
                    part = left[k : k + (1 << 15)]
                    ok[part] = at_home(x[part], y[part], token[part])
            return ok, COORDINATES - count

        return run


def _signed(k: int, names: Names):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo, hi, texts in column_slices(b.column(1)):
                doc, h = shingle_sets(texts, k)
                n = np.bincount(doc, minlength=hi - lo)
                own = signatures(doc, h, n)
                both = [pa.array(x(doc, h, n)) for x in (names.first, names.second)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int32()), *both, pa.array([a.tobytes() + m for a, m in zip(own, bitmaps(doc, h, n).to_pylist())], pa.binary())], names=["id", "n", "node", "second", "bits"])

    return run


def _stacked(raw: list[bytes]) -> np.ndarray:
    """The signatures of marks, each a signature and a bitmap."""
    return np.frombuffer(b"".join([r[:WIDTH] for r in raw]), np.uint32).reshape(-1, COORDINATES)


def _pair_counts(batches):
    """Signatures to the task's table of counters, in chunks."""
    import pyarrow as pa

    counts, seen = np.zeros(CELLS, np.uint32), 0
    for b in batches:
        for lo in range(0, b.num_rows, 2048):
            h = pair_hashes(_stacked(b.column(0).slice(lo, 2048).to_pylist())).ravel()
            counts += cells_of(h)
            seen += len(h)
    if seen:
        yield pa.RecordBatch.from_arrays(list(tallied(counts, pa)), names=["chunk", "counts"])


def _posted(shared, buckets: int, length: int):
    """(node, n, signature) to the rarest ``length`` coordinate-value pairs, packed by bucket."""

    def run(batches):
        order = Order(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                node, n, h = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.int64), pair_hashes(_stacked(part.column(2).to_pylist()))
                doc, c = np.nonzero(prefix_pairs(h, order, length))
                yield packs(node, n, doc, h[doc, c], np.zeros(len(doc), np.int64), order, buckets)

    return run


def minhash_join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, percent: int = PERCENT, matches: int = MATCHES, digest_bits: int = 64) -> DataFrame:
    """One row per input row: key, n_shingles, component_id, kept."""
    spark, ws, names = docs.sparkSession, Workspace(docs.sparkSession, "minhash"), Names(digest_bits)
    own = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    sets = ws.write(own.mapInArrow(tidy(_signed(k, names)), SETS), "sets")
    rows, marks = grouped(sets, names, ws)
    cells = frequencies(marks.select("bits").mapInArrow(_pair_counts, "chunk int, counts binary"))
    shared = spark.sparkContext.broadcast(cells)  # a table of fixed size
    filters = CollisionFilters(percent, matches, shared)
    nodes, length = int(cells.sum(dtype=np.uint64)) // COORDINATES, filters.length
    buckets = int(max(2 * spark.sparkContext.defaultParallelism, -(-nodes * length * 8 // BUCKET_BYTES)))
    parts = marks.select("node", "n", "bits").mapInArrow(tidy(_posted(shared, buckets, length)), PACK).repartition(buckets, "bucket")
    postings = ws.write(parts.mapInArrow(tidy(_lists(shared, filters)), POSTING), "postings")
    found = linked_components(postings, marks, own.filter("id is not null and text is not null"), filters, k, names, ws)
    return ws.result(with_components(rows, found, key).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    return minhash_join(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.c + y.c - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
