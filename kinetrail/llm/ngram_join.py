"""N-gram Jaccard join: near duplicates by rare-first prefix filtering.

Two documents link when ``percent``/100 or more of the union of their shingle sets
is shared. With n shingles and a common total order of all shingles, linked
documents share one of their first n - ceil(n * percent / 100) + 1 shingles.

1. Sets. One pass gives each row its set's size, two 64-bit digests, a parity bitmap of
   n to 2n bits, and counts of all shingles in a fixed table of ``CELLS`` counters. Equal
   sets are one node from here on: its name is the first digest, or the second where
   the first stands for several sets, which the grouping of the sets finds out.
2. Prefixes. Shingles are ordered by their counter, then by hash: rare first. Any
   order is correct, this one keeps frequent passages, lines and licences out of the
   prefixes. Prefixes go, packed, to buckets of bounded size; the lists of very
   frequent shingles are salted over several buckets.
3. Hubs. In a list the nodes are sorted by size; the smallest is the hub of all whose
   size and place permit a link (length and positional filter), the next one beyond
   becomes the next hub. So a group of copies of any size proposes stars of pairs,
   one pair per member and list, never all pairs. A list that has only one hub is
   settled for that hub.
4. A pair's bitmaps bound the difference of its sets from below. What they permit is
   verified once, from the texts: a suffix filter over hash ranges bounds the overlap,
   then the sets are intersected exactly. Links give components.
5. Open lists are those that touch several components. Their members meet in one task
   (long lists in blocks, of which no two lie in the largest component), where pairs
   across components pass the length, positional and bitmap filters. At first
   each member's closest partner is verified, which joins what belongs together; the
   last time all pairs that are left are. Pairs inside a component cannot change it and
   pairs that a filter refuses cannot link, so the components are exact.

Defined results. Null, empty and blank texts have no shingle, no link, and
component_id = doc_id. Texts with fewer than ``k`` words have one shingle, the whole
sequence. Every row counts with its own text, also where an id repeats; equal ids
alone do not link. Rows with a null id link with nothing and have a null component.
An empty table gives an empty table. Only key and text are read.

Two unequal sets share both digests with a chance of 2**-128 a pair, two unequal shingles
a hash with one of 2**-64; that is the method's only error.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mixed, table, tidy
from .components import components
from .shingles import BASE, STEP, column_slices, shingle_sets

K, PERCENT = 5, 75
LOG_CELLS, CHUNKS = 20, 64
CELLS = 1 << LOG_CELLS
SALT_ROWS, BLOCK, BUCKET_BYTES, ROUNDS = 50_000, 2048, 8 << 20, 1
BROADCAST_IDS, BROADCAST_BYTES, PAIRS_AT_ONCE = 1_000_000, 16 << 20, 1 << 18
SETS = "id long, n int, node long, second long, bits binary, chunk int, counts binary"
PACK = "bucket int, nodes binary, sizes binary, lengths binary, tokens binary"
POSTING = "token long, node long, n int, place int, hub long, open boolean"


def _binary(data: np.ndarray, starts: np.ndarray):
    """Binary array of ``data`` cut at ``starts`` (row numbers of ``data``)."""
    import pyarrow as pa

    offsets = np.append(starts, len(data)) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


# sets -------------------------------------------------------------------------


def prefix_length(n, percent: int):
    return n - -(-n * percent // 100) + 1


def digests(doc: np.ndarray, h: np.ndarray, n: np.ndarray, seed=STEP, bits: int = 64) -> np.ndarray:
    """A digest of each set; rows (doc, h) are sorted by doc."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ seed), dtype=np.uint64)])
    ends = np.cumsum(n)
    return (mixed(sums[ends] - sums[ends - n] + n.astype(np.uint64) * STEP) >> np.uint64(64 - bits)).view(np.int64)


class Names:
    """Names of sets: first digests, second ones where the first is ``taken`` by several sets."""

    def __init__(self, bits: int = 64):
        self.bits, self.taken = bits, np.zeros(0, np.int64)

    def first(self, doc, h, n):
        return digests(doc, h, n, bits=self.bits)

    def second(self, doc, h, n):
        return digests(doc, h, n, BASE)

    def of(self, doc, h, n):
        name = self.first(doc, h, n)
        if len(self.taken):
            name = np.where(np.isin(name, self.taken), self.second(doc, h, n), name)
        return name


def levels(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the bitmap's bits: n to 2n, 64 at least."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def bitmaps(doc: np.ndarray, h: np.ndarray, n: np.ndarray):
    """Binary array of bitmaps in which each shingle flips one bit."""
    size = np.int64(1) << levels(n)
    first = np.cumsum(size) - size
    at = first[doc] + (h & (size[doc] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(np.uint8), bitorder="little")
    return _binary(bits, first // 8)


def tallied(counts: np.ndarray, pa) -> tuple:
    """(chunk, counts) columns of a table of counters."""
    return pa.array(range(CHUNKS), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)], pa.binary())


def cells_of(h: np.ndarray) -> np.ndarray:
    return np.bincount((h >> np.uint64(64 - LOG_CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32)


def _sets(k: int, names: Names):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("second", pa.int64()), ("bits", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
        counts, seen = np.zeros(CELLS, np.uint32), 0
        for b in batches:
            for lo, hi, texts in column_slices(b.column(1)):
                doc, h = shingle_sets(texts, k)
                counts += cells_of(h)
                seen += len(h)
                n = np.bincount(doc, minlength=hi - lo)
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.binary())]
                both = [pa.array(x(doc, h, n)) for x in (names.first, names.second)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int32()), *both, bitmaps(doc, h, n), *none], schema=schema)
        if seen:
            none = [pa.nulls(CHUNKS, f.type) for f in list(schema)[:5]]
            yield pa.RecordBatch.from_arrays([*none, *tallied(counts, pa)], schema=schema)

    return run


def _add(batches):
    """Counter chunks (chunk, counts) of one partition summed; they end at 2**32 - 1."""
    import pyarrow as pa

    held: dict[int, np.ndarray] = {}
    for b in batches:
        for c, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
            held[c] = np.minimum(held[c] + counts, np.uint64(2**32 - 1)) if c in held else counts
    if held:
        packed = [zlib.compress(v.astype(np.uint32).tobytes(), 1) for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "counts"])


class Order:
    """Rare first, by the counter of the cell; ``pieces`` of a frequent shingle's list."""

    def __init__(self, cells: np.ndarray):
        usual = 2 * int(cells.sum(dtype=np.uint64)) // CELLS
        self.cells, self.usual = cells, usual

    def rank(self, h: np.ndarray) -> np.ndarray:
        return self.cells[(h >> np.uint64(64 - LOG_CELLS)).astype(np.int64)]

    def pieces(self, h: np.ndarray) -> np.ndarray:
        above = self.rank(h).astype(np.int64) - self.usual
        return np.maximum(above, 0) // SALT_ROWS + 1


def frequencies(counted: DataFrame) -> np.ndarray:
    """The summed table of counters of rows (chunk, counts)."""
    chunks = counted.mapInArrow(_add, "chunk int, counts binary")
    cells = np.zeros((CHUNKS, CELLS // CHUNKS), np.uint32)
    for r in chunks.repartition(8, "chunk").mapInArrow(_add, "chunk int, counts binary").collect():
        cells[r[0]] = np.frombuffer(zlib.decompress(r[1]), np.uint32)
    return cells.ravel()


# prefixes and lists -----------------------------------------------------------


def packs(node: np.ndarray, n: np.ndarray, doc: np.ndarray, h: np.ndarray, part: np.ndarray, order: Order, buckets: int):
    """Rows (doc, hash, place in 256ths of the prefix) packed by bucket as one Arrow batch.

    A token is the upper 56 bits of a hash and, below, its place.
    """
    import pyarrow as pa

    low = np.uint64(255)
    token, salt, pieces = (h & ~low) | part.astype(np.uint64), h & ~low, order.pieces(h)
    hot = np.flatnonzero(pieces > 1)
    if len(hot):
        salt[hot] += mixed(node[doc[hot]].view(np.uint64) ^ salt[hot]) % pieces[hot].astype(np.uint64)
    bucket = (mixed(salt) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((doc, bucket))
    doc, token, bucket = doc[by], token[by], bucket[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
    heads = np.flatnonzero(new)
    lengths = np.diff(np.append(heads, len(doc)))
    first = np.flatnonzero(np.concatenate([[True], bucket[heads[1:]] != bucket[heads[:-1]]]))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[heads[first]], pa.int32()), _binary(node[doc[heads]], first), _binary(n[doc[heads]].astype(np.int32), first), _binary(lengths.astype(np.int32), first), _binary(token, heads[first])],
        names=["bucket", "nodes", "sizes", "lengths", "tokens"],
    )


def _prefixes(shared, k: int, percent: int, buckets: int, names: Names):
    """Prefixes of a slice's different sets, packed by bucket."""

    def run(batches):
        order = Order(shared.value)
        for b in batches:
            for lo, hi, texts in column_slices(b.column(0)):
                doc, h = shingle_sets(texts, k, order.rank)
                if not len(h):
                    continue
                n = np.bincount(doc, minlength=hi - lo)
                node = names.of(doc, h, n)
                once = np.zeros(hi - lo, bool)
                once[np.unique(node, return_index=True)[1]] = True
                place, most = np.arange(len(h)) - (np.cumsum(n) - n)[doc], prefix_length(n, percent)[doc]
                keep = (place < most) & once[doc]
                yield packs(node, n, doc[keep], h[keep], (place * 256 // most)[keep], order, buckets)

    return run


def hubs(token: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Row number of each row's hub; rows are sorted by token, then size."""
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    lists = np.cumsum(new) - 1
    hub, at = np.full(len(token), -1), np.flatnonzero(new)
    left = np.arange(len(token))
    while len(left):
        current = at[lists[left]]
        fits = n[left] * percent <= n[current] * 100
        hub[left[fits]] = current[fits]
        left = left[~fits]
        if len(left):
            first = np.ones(len(left), bool)
            first[1:] = lists[left[1:]] != lists[left[:-1]]
            at[lists[left[first]]] = left[first]
    return hub


def may_link(nx, ny, x, y, percent: int):
    """Length and positional filter at a common shingle at places x and y, or later."""
    return (np.maximum(nx, ny) * percent <= np.minimum(nx, ny) * 100) & (np.minimum(nx - x, ny - y) * (100 + percent) >= percent * (nx + ny))


class ShingleFilters:
    """What a pair of sets must meet before its texts are read: lengths, places, bitmaps."""

    def __init__(self, percent: int):
        self.percent = percent

    def place(self, part: np.ndarray, n: np.ndarray) -> np.ndarray:
        return part * prefix_length(n, self.percent) // 256  # at most the true place

    def may_link(self, nx, ny, x, y):
        return may_link(nx, ny, x, y, self.percent)

    def compared(self, n: np.ndarray, raw: list[bytes]):
        """A function of row numbers (x, y) and the list where they met: which pairs may link
        and are answered there, and how far apart they are at least."""
        bits, percent = Bitmaps(n, raw), self.percent

        def run(x, y, token=None):
            differ = bits.differ(x, y)
            return permits(n[x], n[y], differ, percent), differ

        return run


def _lists(shared, filters):
    """Shingles that two sets of fitting sizes share, with each one's hub (null: no link).

    Salted shingles keep every row open, a lone one too: their others may be elsewhere. Rows
    that are not open are of lists whose pairs are all hub pairs.
    """

    def run(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        for b in batches:
            for k, *columns in zip(*(b.column(c).to_pylist() for c in range(5))):
                held.setdefault(k, []).append(columns)
        order, percent = Order(shared.value), filters.percent
        for k in list(held):  # one bucket at a time
            parts = zip(*held.pop(k))
            yield from lists(*(np.frombuffer(b"".join(x), t) for x, t in zip(parts, (np.int64, np.int32, np.int32, np.uint64))), order, percent, pa)

    def lists(nodes, sizes, lengths, tokens, order, percent, pa):
        row, key = np.repeat(np.arange(len(nodes)), lengths), tokens >> np.uint64(8)
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        shared = np.zeros(len(by), bool)
        shared[1:] |= same
        shared[:-1] |= same
        shared |= order.pieces(tokens[by]) > 1
        at = by[shared]
        key, owner, place = key[at], row[at], (tokens[at] & np.uint64(255)).astype(np.int64)
        node, n, salted = nodes[owner], sizes[owner].astype(np.int64), order.pieces(tokens[at]) > 1
        by = np.lexsort((node, n, key))
        key, node, n, place, salted = key[by], node[by], n[by], place[by], salted[by]
        once = np.ones(len(key), bool)  # equal sets are one node
        once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, place, salted = key[once], node[once], n[once], place[once], salted[once]
        near = salted.copy()  # or a neighbour in the list fits in size
        fit = (key[1:] == key[:-1]) & (n[1:] * percent <= n[:-1] * 100)
        near[1:] |= fit
        near[:-1] |= fit
        key, node, n, place, salted = key[near], node[near], n[near], place[near], salted[near]
        if not len(key):
            return
        place = filters.place(place, n)
        hub = hubs(key, n, percent)
        pair = (hub != np.arange(len(hub))) & filters.may_link(n, n[hub], place, place[hub])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        number = np.cumsum(new) - 1
        single = np.bincount(number, hub == np.arange(len(hub)))[number] == 1
        settled = single & ~salted  # all pairs with the only hub are proposed or refused
        left = np.bincount(number)[number] - settled
        opened = ~(settled & (hub == np.arange(len(hub)))) & ((left > 1) | salted)
        out = pair | opened
        columns = [key.view(np.int64)[out], node[out], n[out], place[out], node[hub][out], opened[out]]
        links = pair[out]
        for k in range(0, len(links), 1 << 18):
            part = slice(k, k + (1 << 18))
            hub_of = pa.array(columns[4][part], mask=~links[part])
            yield pa.RecordBatch.from_arrays([pa.array(columns[0][part]), pa.array(columns[1][part]), pa.array(columns[2][part], pa.int32()), pa.array(columns[3][part], pa.int32()), hub_of, pa.array(columns[5][part])], names=["token", "node", "n", "place", "hub", "open"])

    return run


# filters and verification -----------------------------------------------------


def folded(m: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows, words) of the same sets with fewer bits."""
    while m.shape[1] > words:
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return m


class Bitmaps:
    """Bitmaps of rows, stacked by size."""

    def __init__(self, n: np.ndarray, raw: list[bytes]):
        self.level = levels(n)
        self.at, self.of = np.zeros(len(n), np.int64), {}
        for k in np.unique(self.level):
            rows = np.flatnonzero(self.level == k)
            self.at[rows] = np.arange(len(rows))
            self.of[k] = np.frombuffer(b"".join([raw[i] for i in rows]), np.uint64).reshape(len(rows), -1)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits in which rows x and y differ, in the smaller size of the two."""
        lx, ly = self.level[x], self.level[y]
        out, kind = np.zeros(len(x), np.int64), lx * 64 + ly
        for k in np.unique(kind):
            rows, words = np.flatnonzero(kind == k), (1 << int(min(k // 64, k % 64))) // 64
            a, b = (folded(self.of[level], words) for level in (k // 64, k % 64))
            step = max(1, (1 << 19) // words)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                out[part] = np.bitwise_count(a[self.at[x[part]]] ^ b[self.at[y[part]]]).sum(1)
        return out


def permits(nx: np.ndarray, ny: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that differ in at least so many shingles may link."""
    common = (nx + ny - differ) // 2
    return (100 * common >= percent * (nx + ny - common)) & (np.minimum(nx, ny) > 0)


def _mark_filter(filters):
    """Pairs (u, v, sizes, marks) that may link."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 8192):
                part = b.slice(k, 8192)
                n = np.concatenate([part.column(c).to_numpy().astype(np.int64) for c in (2, 3)])
                rows = np.arange(part.num_rows)
                ok, _ = filters.compared(n, part.column(4).to_pylist() + part.column(5).to_pylist())(rows, rows + part.num_rows)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in part.columns[:2]], names=["u", "v"])

    return run


def list_pairs(ends: np.ndarray, most: int):
    """All (x, y), x < y, of rows x whose list ends at ends[x], about ``most`` at a time."""
    many = ends - np.arange(len(ends)) - 1
    total = np.cumsum(many)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        part = many[lo:hi]
        x = np.repeat(np.arange(lo, hi), part)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(part) - part, part)
        lo = hi


def _open_pairs(filters, every: bool):
    """Pairs of the same list in different components that the filters permit.

    Rows (token, a, b, own, n, place, node, component, bits) come sorted by token, a, b. Of
    blocks a < b only pairs across the blocks count. Unless ``every``, a task keeps the closest
    partner of each node, and one pair at least of each list.
    """

    def closest(token, differ, u, v):
        by = np.lexsort((v, u, differ))
        take = np.concatenate([by[np.unique(c[by], return_index=True)[1]] for c in (u, v, token)])
        return np.unique(take)

    def flush(parts, pa):
        import pyarrow.compute as pc

        t = pa.Table.from_batches(parts).combine_chunks()
        token, a, b, own, n, place, node, comp = (pc.cast(t.column(c), pa.int64()).to_numpy() for c in range(8))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        number = np.cumsum(new) - 1
        compare, found = filters.compared(n, t.column(8).to_pylist()), []
        for x, y in list_pairs(np.append(np.flatnonzero(new)[1:], len(token))[number], PAIRS_AT_ONCE):
            ok = (comp[x] != comp[y]) & ((a[x] == b[x]) | (own[x] != own[y])) & filters.may_link(n[x], n[y], place[x], place[y])
            x, y = x[ok], y[ok]
            ok, differ = compare(x, y, token[x])
            x, y, differ = x[ok], y[ok], differ[ok]
            pairs = token[x], differ, np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            if len(x):
                take = slice(None) if every else closest(*pairs)
                found.append([p[take] for p in pairs])
        if found:
            pairs = [np.concatenate(p) for p in zip(*found)]
            take = np.unique(np.stack(pairs[2:], 1), axis=0, return_index=True)[1] if every else closest(*pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[c][take]) for c in (0, 2, 3)], names=["token", "u", "v"])

    def run(batches):
        import pyarrow as pa

        held: list = []
        for b in batches:
            keys = [b.column(c).to_numpy() for c in range(3)]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if b.num_rows else []
            cut = int(last[-1]) + 1 if len(last) else 0  # rows from here on may go on in the next batch
            if held and b.num_rows:
                same = [int(held[-1].column(c)[-1].as_py()) == int(keys[c][0]) for c in range(3)]
                if cut or not all(same):
                    yield from flush([*held, b.slice(0, cut)] if cut else held, pa)
                    held = []
            elif cut:
                yield from flush([b.slice(0, cut)], pa)
            if b.num_rows:
                held.append(b.slice(cut))
        if held:
            yield from flush(held, pa)

    return run


def _verify(k: int, percent: int, names: Names):
    """Pairs (u, v, text, text) that truly link, of texts with the digests u and v."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            nodes = np.stack([b.column(c).to_numpy() for c in (0, 1)], 1)
            for lo, hi, left in column_slices(b.column(2)):  # linked texts are of about the same length
                right = b.column(3).slice(lo, hi - lo).cast(pa.binary()).to_pylist()
                doc, h = shingle_sets([x for p in zip(left, right) for x in p], k)
                size = np.bincount(doc, minlength=2 * (hi - lo))
                x, y = size[0::2], size[1::2]
                ranges = np.bincount(doc * 16 + (h >> np.uint64(60)).astype(np.int64), minlength=32 * (hi - lo)).reshape(-1, 2, 16)
                most = ranges.min(1).sum(1)  # suffix filter: no more can be common
                own = (names.of(doc, h, size).reshape(-1, 2) == nodes[lo:hi]).all(1)  # an id may have other texts
                may = own & (most * (100 + percent) >= percent * (x + y)) & (x > 0) & (y > 0)
                keep = may[doc // 2]
                pair, h = doc[keep] // 2, h[keep]
                order = np.lexsort((h, pair))
                pair, h = pair[order], h[order]
                common = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=hi - lo)
                ok = lo + np.flatnonzero(may & (100 * common >= percent * (x + y - common)))
                if len(ok):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok)), b.column(1).take(pa.array(ok))], names=["u", "v"])

    return run


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be short; else an ordinary join."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def verified(pairs: DataFrame, marks: DataFrame, docs: DataFrame, k: int, percent: int, names: Names, ws: Workspace, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose texts link. docs (id, text)."""
    one = lambda n: marks.select(F.col("node").alias(n), F.col("id").alias(f"{n}_id"))
    known = ws.write(pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", "u_id", "v_id"), f"{name}-ids")
    ids = known.select(F.explode(F.array("u_id", "v_id")).alias("id")).distinct()
    own = docs.join(_few(ids), "id", "left_semi").groupBy("id", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))  # an id may have several texts; equal ones are one
    both = known.join(own.select(F.col("id").alias("u_id"), F.col("text").alias("u_text")), "u_id").join(own.select(F.col("id").alias("v_id"), F.col("text").alias("v_text")), "v_id")
    links = ws.write(both.select("u", "v", "u_text", "v_text").mapInArrow(tidy(_verify(k, percent, names)), "u long, v long"), f"{name}-links")
    ws.drop(f"{name}-ids")
    return links


# components -------------------------------------------------------------------


def _star_pairs(postings: DataFrame, marks: DataFrame, filters) -> DataFrame:
    """Pairs (u, v) of members and hubs that the marks permit."""
    pairs = postings.filter("hub is not null").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
    one = lambda n: marks.select(F.col("node").alias(n), F.col("n").alias(f"{n}_n"), F.col("bits").alias(f"{n}_bits"))
    marked = pairs.join(one("u"), "u").join(one("v"), "v").select("u", "v", "u_n", "v_n", "u_bits", "v_bits")
    return marked.mapInArrow(_mark_filter(filters), "u long, v long")


def _open_lists(known: DataFrame, marks: DataFrame, found: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """Members of lists that touch several components, with bitmaps, long lists in blocks."""
    placed = ws.write(known.join(found.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")), f"{name}-placed")
    kinds = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
    lists = kinds.groupBy("token").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    members = placed.join(lists.select("token", "total", "most"), "token")
    long, blocks = F.col("total") > BLOCK, lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    few, many = blocks(F.col("total") - F.col("most.c")), blocks(F.col("most.c"))
    largest, draw = F.col("component") == F.col("most.component"), F.xxhash64("node")
    own = F.when(~long, F.lit(0)).when(largest, few + F.pmod(draw, many)).otherwise(F.pmod(draw, few)).cast("int")
    last = F.when(~long, F.lit(0)).when(largest, few - 1).otherwise(few + many - 1)  # blocks of the largest component do not meet
    rows = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "n", "place", "node", "component")
    bits = ws.write(marks.join(members.select("node").distinct(), "node", "left_semi").select("node", "bits"), f"{name}-bits")
    size = bits.agg(F.sum(F.length("bits") + 32)).first()[0] or 0
    rows = rows.repartition("token", "a", "b").join(F.broadcast(bits), "node") if size <= BROADCAST_BYTES else rows.join(bits, "node").repartition("token", "a", "b")
    return rows.sortWithinPartitions("token", "a", "b").select("token", "a", "b", "own", "n", "place", "node", "component", "bits")


def grouped(sets: DataFrame, names: Names, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, n, node) of all rows, and (node, id, n, bits) of all different sets, named by ``names``."""

    def marks(rows):
        own = rows.filter("id is not null and n > 0").groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("n", "bits")).alias("own"), F.min("second").alias("least"), F.max("second").alias("most"))
        return own.select("node", "id", "own.n", "own.bits", (F.col("least") != F.col("most")).alias("taken"))

    rows = sets.filter("n is not null")
    found = ws.write(marks(rows), "marks")
    names.taken = np.array([r["node"] for r in found.filter("taken").select("node").collect()], np.int64)  # sets**2 / 2**65 are to be expected
    if len(names.taken):
        rows = rows.withColumn("node", F.when(F.col("node").isin(names.taken.tolist()), F.col("second")).otherwise(F.col("node")))
        found = ws.write(marks(rows), "named")
    return rows.select("id", "n", "node"), found.drop("taken")


def linked_components(postings: DataFrame, marks: DataFrame, texts: DataFrame, filters, k: int, names: Names, ws: Workspace) -> DataFrame:
    """(node, component_id) of all nodes, by hubs, then by open lists. texts (id, text)."""
    percent = filters.percent
    tried = ws.write(_star_pairs(postings, marks, filters), "stars")
    links = verified(tried, marks, texts, k, percent, names, ws, "stars")
    found = components(links, ws, "stars")
    known = postings.filter("open").select("token", "node", "n", "place")
    for step in range(ROUNDS + 1):
        name, last = f"round-{step}", step == ROUNDS
        pairs = ws.write(_open_lists(known, marks, found, ws, name).mapInArrow(tidy(_open_pairs(filters, last)), "token long, u long, v long"), name)
        if pairs.isEmpty():
            break
        new = ws.write(pairs.select("u", "v").distinct().join(tried, ["u", "v"], "left_anti"), f"{name}-new")
        ws.drop(f"{name}-placed", f"{name}-bits")
        more = verified(new, marks, texts, k, percent, names, ws, name)
        if not more.isEmpty():
            links = links.union(more)
            found = components(links, ws, name)
        if last:
            break
        tried = tried.union(new)
        known = known.join(pairs.select("token").distinct(), "token", "left_semi")  # the other lists have no pair left
    all_nodes = marks.select("node", "id").join(found.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = all_nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    return all_nodes.join(least, "component").select("node", "component_id")


def near_components(docs: DataFrame, ws: Workspace, k: int = K, percent: int = PERCENT, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """docs (id, text). Rows (id, n, node) of all documents, and (node, component_id)."""
    spark, names, filters = docs.sparkSession, Names(digest_bits), ShingleFilters(percent)
    sets = ws.write(docs.mapInArrow(tidy(_sets(k, names)), SETS), "sets")
    cells = frequencies(sets.filter("chunk is not null").select("chunk", "counts"))
    shared = spark.sparkContext.broadcast(cells)
    buckets = int(max(2 * spark.sparkContext.defaultParallelism, -(-int(cells.sum(dtype=np.uint64)) * 8 * (100 - percent) // (100 * BUCKET_BYTES))))
    rows, marks = grouped(sets, names, ws)
    texts = docs.filter("id is not null and text is not null")
    parts = texts.select("text").mapInArrow(tidy(_prefixes(shared, k, percent, buckets, names)), PACK).repartition(buckets, "bucket")
    postings = ws.write(parts.mapInArrow(tidy(_lists(shared, filters)), POSTING), "postings")
    return rows, linked_components(postings, marks, texts, filters, k, names, ws)


def with_components(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """One row per input row: key, n_shingles, component_id."""
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    return rows.join(nodes, "node", "left").select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def ngram_join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, percent: int = PERCENT, digest_bits: int = 64) -> DataFrame:
    """One row per input row: key, n_shingles, component_id."""
    ws = Workspace(docs.sparkSession, "ngram")
    rows, nodes = near_components(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")), ws, k, percent, digest_bits)
    return ws.result(with_components(rows, nodes, key))


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that another id of their component stands for."""
    found = ngram_join(docs.select(F.col(key).cast("long").alias("__nj_id"), F.col(text).alias("__nj_text")), "__nj_text", "__nj_id", k, percent)
    gone = found.groupBy("__nj_id").agg(F.max(F.col("__nj_id") == F.col("component_id")).alias("stays")).filter("not stays").select(F.col("__nj_id").alias("__nj_gone"))
    return docs.join(_few(gone), docs[key].cast("long") == gone["__nj_gone"], "left_anti")


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.c + y.c - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""
