"""MinHash near-duplicates against brute force over all pairs and against the SQL."""

import itertools
import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kinetrail.llm import components, minhash, ngram_join
from kinetrail.llm import shingles as sh

DATA = "/root/testdata/sf0.01"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def set_of(t):
    w = words_of(t)
    return frozenset([tuple(w)] if 0 < len(w) < 4 else [tuple(w[i : i + 4]) for i in range(len(w) - 3)])


def plain(rows):
    sets, parent = [set_of(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i, r in enumerate(rows) if r[0] is not None and sets[i]], 2):
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= 80 * len(x | y):
            parent[root(b)] = root(a)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, len(sets[i]), least.get(root(i)), key is None or key == least[root(i)]) for i, (key, _) in enumerate(rows)), key=str)


def rows_of(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    line, rows = " ".join(word() for _ in range(15)), []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(1, 80))]
        rows.append((1000 * (seed + 1) - i, " ".join(w) + (" " + line if rng.random() < 0.2 else "")))
    return rows


def edges():
    w = [str(i) for i in range(120_000)]
    long = [(90_001, " ".join(w)), (90_000, " ".join(w[:-9_000])), (90_002, " ".join(w[:80_000]))]
    return long + [(1, None), (2, ""), (3, " \n"), (4, "a b"), (8, "A\tB"), (None, "null id"), (None, "a b"), (5, "same words here now"), (5, "same words here now"), (5, "one id, another text than above"), (6, "One id, another text than above")]


def test_join_equals_brute_force(spark, monkeypatch):
    rows = edges() + [r for seed in range(4) for r in rows_of(seed)]
    want = plain(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    found = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = minhash.minhash_join(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and found(got) == want
    for name, value in (("SALT_ROWS", 2), ("BLOCK", 4), ("BROADCAST_IDS", 0), ("BROADCAST_BYTES", 0), ("PAIRS_AT_ONCE", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(components, "TASK_LINKS", 30)
    assert found(minhash.minhash_join(frame, digest_bits=6)) == want
    assert minhash.minhash_join(frame.limit(0)).collect() == []


def test_query_equals_its_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(duckdb.sql(f"SELECT doc_id, n_shingles, component_id, kept FROM ({minhash.ORACLE})").fetchall())
    got = sorted(map(tuple, minhash.op13_minhash(spark, DATA).collect()))
    assert got == want and any(not r[3] for r in got)


def test_collisions_estimate_similarity_and_skipping_keeps_the_decision():
    rng = random.Random(2)
    texts = []
    for size in (40, 200, 900):
        for _ in range(40):
            w = [str(rng.random()) for _ in range(size)]
            other = list(w)
            for _ in range(rng.randint(0, size // 8)):
                other[rng.randrange(size)] = "x" + str(rng.random())
            texts += [" ".join(w), " ".join(other)]
    doc, h = sh.shingle_sets([t.encode() for t in texts], 4)
    n = np.bincount(doc, minlength=len(texts))
    own = minhash.signatures(doc, h, n)
    x, y = np.arange(0, len(texts), 2), np.arange(1, len(texts), 2)
    exact = (own[x] == own[y]).sum(1)
    for matches in (1, 20, 48, 90, 96):
        assert ((minhash.collisions(own, own, x, y, matches) >= matches) == (exact >= matches)).all()
    true = np.array([len(set_of(texts[a]) & set_of(texts[b])) / len(set_of(texts[a]) | set_of(texts[b])) for a, b in zip(x, y)])
    assert abs(exact / minhash.COORDINATES - true).mean() < 0.05
    assert (exact[true >= 0.8] >= minhash.MATCHES).all() and (true >= 0.8).sum() > 10


def test_a_large_group_of_copies_is_one_component(spark):
    """600 near copies of one text and as many exact ones."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(1200):
        w = list(base)
        if i % 2:
            w[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(w)))
    out = minhash.minhash_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert out.agg(F.max("component_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (0, 1)
