"""Ranked lexical search against the SQL and a plain loop over all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from kinetrail.llm import maxscore

DATA = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(docs, items, k=10):
    split = [(i, TERM.findall(lower(t))) for i, t in docs]
    n, total = sum(bool(t) for _, t in split), sum(len(t) for _, t in split)
    df = Counter(x for _, t in split for x in set(t))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in asked.items():
        rows = []
        for d, t in split:
            tf = Counter(t)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * (10 + 90 * len(t) * n // total))) for x in terms if tf[x])
            if score > 0 and d is not None:
                rows.append((-score, d))
        out += [(i, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def ranked(frame):
    return sorted(tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect())


def test_query_equals_its_sql(spark):
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = sorted(duckdb.sql(f"SELECT item_id, rank, doc_id, score FROM ({maxscore.ORACLE})").fetchall())
    got = maxscore.op12_maxscore(spark, DATA)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and ranked(got) == want and len(want) == 400


@pytest.mark.parametrize("part", [4096, 3])
def test_odd_rows_against_a_plain_loop(spark, monkeypatch, part):
    monkeypatch.setattr(maxscore, "BLOCK_DOCS", 7)
    rng = random.Random(5)
    words = ["Alpha", "beta-x", "gamma", "ÄÖ", "中文", "z9", "rare", "of", "of", "the", "the", "\x7f", "__"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "- _ !"), (None, "rare gamma"), (7, "rare rare"), (7, "rare rare"), (503, "rare " * 30_000)]
    items = [(1, "RARE gamma the"), (2, None), (3, "?!"), (None, "beta"), (4, "nowhere"), (5, "the of"), (5, "beta"), (6, "ÄÖ äö 中文 z9 x alpha gamma of the"), (7, "rare rare")]
    left = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, score int").repartition(3)
    right = spark.createDataFrame([(*i, "r") for i in items], "item_id long, text string, rank string")
    assert ranked(maxscore.ranked_search(left, right, part_items=part)) == plain(docs, items)
    assert maxscore.ranked_search(left.limit(0), right).collect() == [] == maxscore.ranked_search(left, right.limit(0)).collect()


def test_pair_bounds_skip_more_and_lose_nothing():
    """Two frequent terms that seldom meet: joint maxima are far below the sums."""
    rng = np.random.default_rng(4)
    n, terms = 4000, 8
    held = [np.flatnonzero((np.arange(n) % 2 == t % 2) & (rng.random(n) < 0.6)) if t < 6 else np.sort(rng.choice(n, 60, replace=False)) for t in range(terms)]
    impact = [rng.integers(50, 100, len(h)) if t < 6 else rng.integers(150, 260, len(h)) for t, h in enumerate(held)]
    units = np.array([(0, 1, 0), (2, 3, 1), (4, 5, 2), (6, 7, 3)])
    both = [np.intersect1d(held[a], held[b], return_indices=True) for a, b, _ in units]
    pack = lambda x, t: np.concatenate(x).astype(t).tobytes()
    row = {"ids": np.arange(n).tobytes(), "terms": np.arange(terms, dtype=np.int32).tobytes(), "ends": np.cumsum([len(h) for h in held]).tobytes(), "docs": pack(held, np.uint32), "impacts": pack(impact, np.int64)}
    row |= {"pairs": np.arange(4).tobytes(), "pair_ends": np.cumsum([len(x[0]) for x in both]).tobytes(), "pair_docs": pack([x[0] for x in both], np.uint32), "pair_impacts": pack([impact[a][x[1]] + impact[b][x[2]] for (a, b, _), x in zip(units, both)], np.int64)}
    block = maxscore.Block(row, terms, 4)
    score = np.zeros(n, np.int64)
    for h, i in zip(held, impact):
        score[h] += i
    for threshold in (0, 1, 120, 200, 300, 420, int(np.sort(score)[-10]), int(score.max()), int(score.max()) + 1):
        want = np.flatnonzero(score >= max(threshold, 1))
        for paired in (True, False):
            docs, got, _ = block.search(units, threshold, paired)
            order = np.argsort(docs)
            assert docs[order].tolist() == want.tolist() and got[order].tolist() == score[want].tolist()
    assert (block.bounds(units) <= block.bounds(units, False)).all()
    third = int(np.sort(score)[-10])
    assert block.search(units, third)[2] < block.search(units, third, False)[2]


def test_lengths_beyond_64_bits_of_the_product():
    n, total, sizes = 3 * 10**10, 10**13, np.array([5, 10**8])
    got = maxscore.impacts(np.array([7, 7]), np.array([1, 3]), sizes, n, total)
    assert got.tolist() == [7 * (10**9 * t // (1000 * t + 8 * (10 + 90 * int(s) * n // total))) for t, s in zip((1, 3), sizes)]
