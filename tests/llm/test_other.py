"""Vectors, pages and the pipeline."""

import base64
import gzip
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinetrail.llm import exact_dedup, ngram_join, topk, warc
from kinetrail.llm.common import Workspace


def test_topk_against_brute_force(spark, monkeypatch):
    random.seed(1)
    rows = [(i * 7 % 500, [random.choice([-0.5, 0.25, 0.125, 1.0]) for _ in range(4)], "x") for i in range(500)]
    rows += [(3, rows[3][1], "again"), (600, None, ""), (601, [1.0, None, 0.0, 0.0], ""), (602, [math.nan] * 4, ""), (603, [math.inf, 0.0, 0.0, 0.0], ""), (700, [1.0, 2.0], "short"), (None, [1.0] * 4, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    for name, n in (("BLOCK_ROWS", 8), ("GROUP_BYTES", 3000), ("QUERY_ROWS", 3)):
        monkeypatch.setattr(topk, name, n)
    got = [tuple(r) for r in topk.topk_search(frame, F.col("vec_id") % 50 == 0, k=5).collect()]
    q = lambda v: [math.floor(1024 * x) for x in v]
    valid = [(i, q(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in valid:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in valid if j != i and len(u) == len(v))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.topk_search(frame.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("bound", [1 << 26, 64])
def test_queries_go_only_to_cells_that_reach_their_seed(spark, monkeypatch, bound):
    """Cells of falling magnitude: the first settles the positive queries, the last the negative ones."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(0.9, 1.0) * (1.0 - i / 1000) * 8 for _ in range(4)]) for i in range(800)]
    rows = [(i, [-x for x in v] if i % 400 == 100 else v) for i, v in rows]
    for name, n in (("BLOCK_ROWS", 8), ("GROUP_BYTES", 2000), ("QUERY_ROWS", 3), ("BOUND_BYTES", bound)):
        monkeypatch.setattr(topk, name, n)
    sent: dict[str, int] = {}
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name, *a: sent.__setitem__(name, out := write(self, df, name, *a)) or out)
    monkeypatch.setattr(Workspace, "result", lambda self, df: df)
    got = [tuple(r) for r in topk.topk_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=3).collect()]
    q = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    want = []
    for i in range(0, 800, 100):
        best = sorted((-sum(a * b for a, b in zip(q[i], u)), j) for j, u in q.items() if j != i)[:3]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    cells = -(-800 * (4 * 8 + 16) // 2000)
    many = sent["sent"].selectExpr("sum(length(ids) / 8)").first()[0]  # pairs of a query and a cell
    assert 8 <= many <= 8 * cells and (bound == 64 or many < 0.6 * 8 * cells)


def test_topk_of_large_components(spark):
    frame = spark.createDataFrame([(1, [131072.0, 0.0]), (100, [1.0, 0.0]), (2, [1e12, -1.0]), (3, []), (200, [])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.topk_search(frame, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(100, 1, 2, 1024 * 1024 * 10**12), (100, 2, 1, 137438953472), (200, 1, 3, 0)]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.topk_search(spark.createDataFrame([(100, [1e15]), (2, [1e15])], frame.schema), F.col("vec_id") % 100 == 0).collect()


def test_pruning_skips_blocks():
    import numpy as np

    blocks = []
    for b in range(6):
        m = np.full((4, 2), 10 - b, np.int64)
        blocks.append((np.arange(4) + 10 * b, m, m.max(0), m.min(0)))
    one = np.array([999]), np.array([[1, 1]]), blocks
    s, i, found, scored = topk.prune_and_score(*one, 3)
    assert s.tolist() == [[20, 20, 20]] and i.tolist() == [[0, 1, 2]] and found.tolist() == [3] and scored.tolist() == [1]
    assert topk.prune_and_score(*one, 6)[3].tolist() == [2]  # the second block fills up, the third cannot
    assert topk.prune_and_score(*one, 24)[3].tolist() == [6]
    s, i, found, scored = topk.prune_and_score(*one, 24, np.array([17]))  # a seed: only what reaches it
    assert scored.tolist() == [2] and found.tolist() == [8] and s[0, :8].tolist() == [20] * 4 + [18] * 4


PAGES = "page_id long, url string, html string, record_type string"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/", "<p>é</p>"), (3, "http://b/", "<p>é</p>"), (9, None, None), (8, "x\r\nInjected: 1", ""), (4, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (3, "http://b/", "<p>é</p>"), (None, "n", "<p>é</p>"), (7, "big", "z" * 200_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(2)
    ws = Workspace(spark, "test")
    warc.write_warc(frame, f"{ws.path}/a", file_bytes=1 << 16, file_pages=4)
    records = warc.read_warc(spark, f"{ws.path}/a")
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert len(got) == len(rows)
    full = [bytes(r["response"]["payload"]).decode() for r in got if r["response"]["record_type"] == "response"]
    assert sorted(full) == sorted({h or "" for _, _, h in rows})
    for r in got:
        assert r["request"]["http_headers"].startswith("GET ") and "page-id" in r["metadata"]["fields"] or r["metadata"]["fields"] is not None
        if r["response"]["record_type"] == "revisit":
            assert r["response"]["refers_to"].split(":")[2] in ("3", "8")
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {r["response"]["payload_digest"] for r in got} == {"sha1:" + sha(h or "") for _, _, h in rows}
    files = spark.read.format("binaryFile").load(f"{ws.path}/a").select("content").collect()
    held = [[len(r["payload"] or b"") for r in warc.parse_warc(bytes(f["content"])) if r["record_type"] != "metadata"] for f in files]
    assert sum(map(len, held)) == 2 * len(rows) and all(sum(x) <= 1 << 16 or len(x) == 2 for x in held) and max(map(sum, held)) == 200_000
    warc.write_warc(frame, f"{ws.path}/b", least_bytes=1)
    assert sum(r["response"]["record_type"] == "response" for r in warc.assemble(warc.read_warc(spark, f"{ws.path}/b")).collect()) == 5
    warc.write_warc(frame.limit(0), f"{ws.path}/c")
    assert warc.read_warc(spark, f"{ws.path}/c").count() == 0


def test_warc_parser_reads_foreign_records_and_rejects_cuts():
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\npayload"
    one = one.replace(b"25", str(len(one.split(b"\r\n\r\n", 1)[1])).encode()) + b"\r\n\r\n"
    assert [r["payload"] for r in warc.parse_warc(gzip.compress(one) + gzip.compress(one))] == [b"payload"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_warc(one[:-8]))
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"no record"))


def test_pipeline_against_plain_python(spark):
    """The stages of the pipeline against their rules, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = corpus_pipeline.identify_language(spark, docs, sf).cache()
    assert one.columns == docs.columns and one.count() == docs.filter(docs.text.rlike(r"\p{L}")).count()
    two = corpus_pipeline.drop_exact_copies(spark, one, sf).cache()
    largest: dict = {}
    for r in one.collect():
        largest[r["text"]] = max(r["doc_id"], largest.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(largest.values())
    from tests.llm.test_documents import join_reference

    three = corpus_pipeline.drop_near_copies(spark, two, sf).cache()
    parts = join_reference([(r["doc_id"], r["text"]) for r in two.collect()])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted({c for _, _, c in parts})
    four = corpus_pipeline.mix_sources(spark, three, sf)
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()}
    five = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in five) == sorted(r["doc_id"] for r in four.collect()) and all(r["round_trip"] for r in five)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "sentencepiece"]


def test_pipeline_stages_on_edges(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "hello there", None, None, 1), (3, "hello there", None, None, 1), (4, "123", None, "s", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (frame, frame.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        assert [r["doc_id"] for r in docs.collect()] == ([3] if start is frame else [])
    assert ngram_join.PERCENT == 75 and exact_dedup.CAPACITY >= 1
