"""Ranked lexical search with pair-bound MaxScore.

A stated set of items (queries) is ranked against all documents, block by block.

1. Items. Their terms are the vocabulary. Items go in parts of bounded size, each with its
   own pass; a part's vocabulary is broadcast.
2. Postings. One pass over the texts gives blocks of documents: ids, lengths in terms, and a
   posting list (document, occurrences) for each term of the vocabulary. The same pass counts
   N, L and the terms' document frequencies, one row per term and task.
3. Index. With these numbers every posting has an impact, its part of the score. Each block
   gets its lists' maximum impacts and, for the pairs that the items name (each item pairs its
   terms by weight, the frequent ones with each other), intersection lists with joint impacts.
4. Search. What two paired terms add to one document is at most the greatest of both maxima
   and the joint maximum, which is below the sum of the maxima unless they meet in one place.
   Units (pairs and single terms) are sorted by bound; the units whose bounds add up to less
   than the item's threshold are not essential: only documents of the others are candidates.
   A candidate is looked up in the intersection list; if it is not there, the pair's bound for
   it falls to the greater maximum, and it is dropped as soon as what is left can't reach the
   threshold. A block whose bounds all add up to less is skipped.
5. The threshold is the k-th score so far in the task, at least the k-th score of a fixed share
   of the blocks, which are searched first. Documents are dropped only below it, never at it,
   so ranks are exact, ties included.

Scores are integers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact
weight * (10**9 tf div (1000 tf + 8 m)), m = 10 + (90 n N) div L.

Defined results. Null, empty and term-less texts match nothing and do not count in N. Items
of one id are one item with all their terms; items with a null id or no term get no row.
Documents with a null id count in N, L and df, but are not ranked. Rows that repeat an id are
ranked one by one. Empty tables give an empty table. Only the keys and texts are read.

Two different terms share a 64-bit hash with a chance of 2**-64 a pair; this is the only error.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, mixed, table, tidy
from .shingles import byte_table, column_slices, word_hashes

K, ITEMS, ITEM_BYTES = 10, 4096, 8 << 20
BLOCK_DOCS, BLOCK_POSTINGS, SEED_SHARE = 2048, 1 << 20, 32
#: Bytes of terms: digits, letters and everything beyond ASCII.
TERMS = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
POSTINGS = "seed int, ids binary, sizes binary, terms binary, ends binary, docs binary, times binary, term int, df long, n long, total long"
INDEX = "seed int, ids binary, terms binary, ends binary, docs binary, impacts binary, pairs binary, pair_ends binary, pair_docs binary, pair_impacts binary"


# items ------------------------------------------------------------------------


def _item_terms(batches):
    """(item, text) to distinct (item, term hash)."""
    import pyarrow as pa

    for b in batches:
        for lo, hi, texts in column_slices(b.column(1)):
            term, owner, _ = word_hashes(texts, TERMS)
            rows = np.unique(np.stack([owner, term.view(np.int64)], 1), axis=0) if len(term) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(rows[:, 0])), pa.array(rows[:, 1])], names=["item", "term"])


class Items:
    """The items of one part: numbers of their terms in a sorted vocabulary of hashes."""

    def __init__(self, rows: list):
        self.vocabulary, number = np.unique(np.array([r["term"] for r in rows], np.int64).view(np.uint64), return_inverse=True)
        by: dict[int, list[int]] = {}
        for r, n in zip(rows, number.tolist()):
            by.setdefault(r["item"], []).append(n)
        self.ids = sorted(by)
        self.terms = [np.array(sorted(by[i]), np.int64) for i in self.ids]

    def units(self, weights: np.ndarray) -> tuple[np.ndarray, list[list[tuple]]]:
        """Distinct pairs (a, b), and each item's units (a, b, pair number) or (a, -1, -1).

        Terms are paired by rising weight, so that long lists meet long lists."""
        number: dict[tuple, int] = {}
        units = []
        for own in self.terms:
            by = own[np.lexsort((own, weights[own]))].tolist()
            pairs = [(min(p), max(p)) for p in zip(by[0::2], by[1::2])]
            units.append([(*p, number.setdefault(p, len(number))) for p in pairs] + [(t, -1, -1) for t in by[2 * len(pairs) :]])
        return np.array(list(number), np.int64).reshape(-1, 2), units


# postings and index -----------------------------------------------------------


def _postings(shared):
    """(id, text) to blocks of posting lists, and at last a row (term, df) for each term and one (n, total)."""

    def run(batches):
        import pyarrow as pa

        vocabulary = shared.value
        df, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        held, docs, size = [], 0, 0
        schema = pa.schema([("seed", pa.int32()), *[(c, pa.binary()) for c in ("ids", "sizes", "terms", "ends", "docs", "times")], ("term", pa.int32()), *[(c, pa.int64()) for c in ("df", "n", "total")]])

        def block(parts):
            ids, sizes, term, doc, times = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((doc, term))
            term, doc, times = term[order], doc[order], times[order]
            last = np.flatnonzero(np.append(term[1:] != term[:-1], True))
            seed = int(mixed(ids.view(np.uint64)[:1])[0] % np.uint64(SEED_SHARE)) == 0
            packed = [ids, sizes, term[last].astype(np.int32), last + 1, doc.astype(np.uint32), times.astype(np.uint32)]
            return pa.RecordBatch.from_arrays([pa.array([int(seed)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed], *[pa.nulls(1, f.type) for f in list(schema)[7:]]], schema=schema)

        for b in batches:
            for lo, hi, texts in column_slices(b.column(1)):
                hashes, owner, count = word_hashes(texts, TERMS)
                n, total = n + int((count > 0).sum()), total + len(hashes)
                if not len(vocabulary) or not len(hashes):
                    continue
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                code, times = np.unique(owner[known] * len(vocabulary) + at[known], return_counts=True)
                doc, term = code // len(vocabulary), code % len(vocabulary)
                df += np.bincount(term, minlength=len(vocabulary))
                key = b.column(0).slice(lo, hi - lo)
                named = key.is_valid().to_numpy(zero_copy_only=False)
                keep = named[doc]
                doc, term, times = doc[keep], term[keep], times[keep]
                own, doc = np.unique(doc, return_inverse=True)
                if not len(own):
                    continue
                held.append((key.fill_null(0).to_numpy()[own], count[own], term, doc + docs, times))
                docs, size = docs + len(own), size + len(doc)
                if docs >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield block(held)
                    held, docs, size = [], 0, 0
        if held:
            yield block(held)
        if n:
            t = np.flatnonzero(df)
            counts = [pa.array(np.append(t, -1), pa.int32()), pa.array(np.append(df[t], 0)), pa.array(np.append(np.zeros_like(t), n)), pa.array(np.append(np.zeros_like(t), total))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(t) + 1, f.type) for f in list(schema)[:7]], *counts], schema=schema)

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, times: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """Parts of the score of postings with so many occurrences in documents of so many terms."""
    if len(sizes) and 90 * n * int(sizes.max()) >= 1 << 63:
        m = np.array([10 + 90 * int(s) * n // total for s in sizes], np.int64)
    else:
        m = 10 + 90 * n * sizes // total
    return weights * (1_000_000_000 * times // (1000 * times + 8 * m))


def _index(shared):
    """Blocks of postings to blocks of impacts with the intersection lists of all pairs."""

    def run(batches):
        import pyarrow as pa

        weights, pairs, n, total = shared.value
        names = [c.split()[0] for c in INDEX.split(", ")]
        for b in batches:
            for r in b.to_pylist():
                ids, sizes, ends = (np.frombuffer(r[c], np.int64) for c in ("ids", "sizes", "ends"))
                terms, docs, times = np.frombuffer(r["terms"], np.int32), np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["times"], np.uint32).astype(np.int64)
                starts = np.append(0, ends[:-1])
                impact = impacts(np.repeat(weights[terms], ends - starts), times, sizes[docs], n, total)
                here = np.full(len(weights), -1)
                here[terms] = np.arange(len(terms))
                dense, both, joint = np.zeros(len(ids), np.int64), [], []
                found = np.flatnonzero((here[pairs] >= 0).all(1)) if len(pairs) else np.zeros(0, np.int64)
                found = found[np.argsort(pairs[found, 0], kind="stable")]
                last = -1
                for p in found.tolist():  # pairs of this block, those of one first term together
                    x, y = here[pairs[p]]
                    if x != last:
                        dense[:] = 0
                        dense[docs[starts[x] : ends[x]]] = impact[starts[x] : ends[x]]
                        last = x
                    second = docs[starts[y] : ends[y]]
                    meet = dense[second] > 0
                    both.append(second[meet])
                    joint.append(dense[both[-1]] + impact[starts[y] : ends[y]][meet])
                packed = [ids, terms, ends, docs, impact, found, np.cumsum([len(x) for x in both], dtype=np.int64)] + [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((both, np.uint32), (joint, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([r["seed"]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], names=names)

    return run


# search -----------------------------------------------------------------------


class Block:
    """One block of the index: lists of terms and pairs with their maxima."""

    def __init__(self, r: dict, terms: int, pairs: int):
        self.ids = np.frombuffer(r["ids"], np.int64)
        self.docs, self.impact = np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["impacts"], np.int64)
        self.pair_docs, self.pair_impact = np.frombuffer(r["pair_docs"], np.uint32), np.frombuffer(r["pair_impacts"], np.int64)
        self.most, self.span = self._lists(np.frombuffer(r["terms"], np.int32), np.frombuffer(r["ends"], np.int64), self.impact, terms)
        self.joint, self.pair_span = self._lists(np.frombuffer(r["pairs"], np.int64), np.frombuffer(r["pair_ends"], np.int64), self.pair_impact, pairs)

    @staticmethod
    def _lists(keys, ends, impact, size):
        most, span = np.zeros(size + 1, np.int64), np.zeros((size + 1, 2), np.int64)  # the last: none
        starts = np.append(0, ends[:-1])[: len(ends)]
        full = ends > starts
        span[keys] = np.stack([starts, ends], 1)
        if full.any():
            most[keys[full]] = np.maximum.reduceat(impact, starts[full])
        return most, span

    def bounds(self, units: np.ndarray, paired: bool = True) -> np.ndarray:
        """What each unit (a, b, pair) can add to one document at most."""
        a, b = self.most[units[:, 0]], self.most[units[:, 1]]
        return np.maximum(np.maximum(a, b), self.joint[units[:, 2]]) if paired else a + b

    def within(self, span, docs: np.ndarray, list_docs, list_impact) -> np.ndarray:
        """Impacts of a list for documents, 0 where it lacks them."""
        lo, hi = span
        if lo == hi:
            return np.zeros(len(docs), np.int64)
        own = list_docs[lo:hi]
        at = np.minimum(np.searchsorted(own, docs), hi - lo - 1)
        return np.where(own[at] == docs, list_impact[lo:hi][at], 0)

    def search(self, units: np.ndarray, threshold: int, paired: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """(document numbers, scores) of at least ``threshold`` and 1, and how many were candidates."""
        bound = self.bounds(units, paired)
        if bound.sum() < max(threshold, 1):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        order = np.argsort(bound, kind="stable")
        order = order[bound[order] > 0]
        below = np.cumsum(bound[order])
        rest = int(np.searchsorted(below, max(threshold, 1)))  # units that cannot reach the threshold together
        spans = self.span[units[order[rest:], :2].ravel()]
        spans = spans[spans[:, 0] < spans[:, 1]]
        score = np.bincount(np.concatenate([self.docs[lo:hi] for lo, hi in spans]), np.concatenate([self.impact[lo:hi] for lo, hi in spans]).astype(np.float64), len(self.ids))  # exact below 2**53
        left = int(below[rest - 1]) if rest else 0
        docs = np.flatnonzero((score > 0) & (score + left >= threshold))
        score, tried = score[docs].astype(np.int64), len(docs)
        for u in order[:rest][::-1].tolist():
            a, b, pair = units[u]
            left -= int(bound[u])
            if pair >= 0 and paired:
                more = self.within(self.pair_span[pair], docs, self.pair_docs, self.pair_impact)
                either = max(self.most[a], self.most[b])  # off the intersection list one of both is missing
                go = (more > 0) | (score + left + either >= threshold)
                docs, score, more = docs[go], score[go], more[go]
                alone = np.flatnonzero(more == 0)
            else:
                more, alone = np.zeros(len(docs), np.int64), np.arange(len(docs))
            for t in (a, b):
                if t >= 0 and len(alone):
                    more[alone] += self.within(self.span[t], docs[alone], self.docs, self.impact)
            score = score + more
            go = score + left >= threshold
            docs, score = docs[go], score[go]
            if not len(docs):
                break
        return docs, score, tried


def _search(shared, k: int):
    """Blocks of the index to each item's k best documents of the task: (item, doc, score)."""

    def run(batches):
        import pyarrow as pa

        ids, units, seeds, terms, pairs = shared.value
        units, best = [np.array(u, np.int64) for u in units], [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        threshold, seen = list(seeds), False
        for b in batches:
            for i in range(b.num_rows):
                block, seen = Block(b.slice(i, 1).to_pylist()[0], terms, pairs), True
                for q, own in enumerate(units):
                    docs, score, _ = block.search(own, threshold[q])
                    if len(docs):
                        doc, score = np.append(best[q][0], block.ids[docs]), np.append(best[q][1], score)
                        top = np.lexsort((doc, -score))[:k]
                        best[q] = doc[top], score[top]
                        if len(top) == k:
                            threshold[q] = max(threshold[q], int(best[q][1][-1]))
        if seen:
            item = np.repeat(np.array(ids, np.int64), [len(x[0]) for x in best])
            yield pa.RecordBatch.from_arrays([pa.array(item), *[pa.array(np.concatenate([x[c] for x in best])) for c in (0, 1)]], names=["item", "doc", "score"])

    return run


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= k)


def _search_part(docs: DataFrame, items: Items, ws: Workspace, part: int, k: int) -> DataFrame:
    """(item, doc, score) with the k best documents of every item among others."""
    context = docs.sparkSession.sparkContext
    found = ws.write(docs.mapInArrow(tidy(_postings(context.broadcast(items.vocabulary))), POSTINGS), f"postings-{part}")
    stats = {r["term"]: r for r in found.filter("term is not null").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "n", "total")]).collect()}  # terms of the items
    n, total = (stats[-1]["n"], stats[-1]["total"]) if -1 in stats else (0, 0)
    weights = np.array([weight(n, stats[t]["df"]) if t in stats else 0 for t in range(len(items.vocabulary))], np.int64)
    pairs, units = items.units(weights)
    shared = context.broadcast((weights, pairs, n, total))
    index = found.filter("term is null").drop("term", "df", "n", "total").mapInArrow(tidy(_index(shared)), INDEX)
    index.write.partitionBy("seed").parquet(f"{ws.path}/index-{part}")
    index = docs.sparkSession.read.schema(INDEX).parquet(f"{ws.path}/index-{part}")
    ws.drop(f"postings-{part}")
    search = lambda blocks, seeds: blocks.mapInArrow(tidy(_search(context.broadcast((items.ids, units, seeds, len(weights), len(pairs))), k)), "item long, doc long, score long")
    first = _ranked(search(index.filter("seed = 1"), [0] * len(units)), k).filter(F.col("rank") == k).select("item", "score").collect()  # one row an item
    seeds = {r["item"]: r["score"] for r in first}
    return search(index, [seeds.get(i, 0) for i in items.ids])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", part_items: int = ITEMS) -> DataFrame:
    """The k best documents of every item: item key, rank int, document key, score long."""
    ws = Workspace(docs.sparkSession, "maxscore")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")).filter("item is not null and text is not null")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // part_items), -(-(size["bytes"] or 0) // ITEM_BYTES))
    found = None
    for i in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == i).mapInArrow(_item_terms, "item long, term long").distinct().collect()  # at most about ITEM_BYTES of text
        if own:
            best = ws.write(_ranked(_search_part(rows, Items(own), ws, i, k), k), f"best-{i}")
            ws.drop(f"index-{i}")
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, doc long, score long, rank int")
    return found.select(F.col("item").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")


def op12_maxscore(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, any_value(len) AS n, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * c.n) // c.l))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
"""
