"""Operators over documents against brute force, with the defined edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import components, exact_dedup, language_id, mixing, ngram_join, pii, sentencepiece_fst, suffix_dedup, toxicity
from kinetrail.llm import shingles as sh

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None, None)[:5] for r in rows], SCHEMA).repartition(3)


EDGES = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (None, "null id"), (5, "same"), (5, "same"), (6, "same"), (7, "x" * 50_000), (8, "A B")]


# exact deduplication ------------------------------------------------------------


def exact_reference(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("capacity", [3, 1024])
def test_exact_groups(spark, capacity):
    rows = EDGES + [(100 + i, "hot") for i in range(200)] + [(400 + i, f"t{i % 37}") for i in range(100)]
    got = exact_dedup.exact_groups(docs(spark, rows), capacity=capacity).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == exact_reference(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in rows})
    stay = exact_dedup.exact_dedup(docs(spark, rows), capacity=capacity)
    assert stay.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = stay.collect()
    assert len({r["text"] or "" for r in out}) == len(out) == len(kept)


@pytest.mark.parametrize("groups", [0, 1000])
def test_exact_dedup_of_repeated_ids(spark, monkeypatch, groups):
    """One id and text with other columns: the smallest row stays, whatever the partitions."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", groups)
    rows = [(5, "same", "b", "s", 1), (5, "same", "a", "s", 2), (5, "same", "a", "s", 2), (4, "same", "0", "s", 0), (5, "other", "z", "s", 9), (None, "", "x", "s", 3), (None, None, "w", "s", 4)]
    clash = lambda n: spark.createDataFrame(rows, SCHEMA).repartition(n).withColumn("id", F.lit("x")).withColumn("n", F.lit(1))
    for n in (1, 5):
        out = exact_dedup.exact_dedup(clash(n))
        assert out.columns == clash(n).columns
        assert {(r["doc_id"], r["text"], r["lang"]) for r in out.collect()} == {(5, "same", "a"), (5, "other", "z"), (None, None, "w")}
        assert out.count() == 3
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_misra_gries_bound():
    random.seed(1)
    items = [random.choice("aab") if random.random() < 0.5 else str(random.random()) for _ in range(2000)]
    counts: dict = {}
    for x in items:
        counts = exact_dedup.misra_gries(counts, {x: 1}, 9)
    assert len(counts) <= 9
    assert items.count("a") - len(items) / 10 <= counts["a"] <= items.count("a")


# n-gram Jaccard join ------------------------------------------------------------


def shingle_reference(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def join_reference(rows):
    """(set size, component) of each row: every row counts with its own text."""
    sets = [shingle_reference(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i, r in enumerate(rows) if r[0] is not None], 2):
        x, y = sets[a], sets[b]
        if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(b)] = root(a)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key) if key is not None else None
    return sorted(((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows)), key=str)


def near_rows(seed, n=120):
    random.seed(seed)
    word = lambda: "".join(random.choice("abcde") for _ in range(3))
    line = " ".join(word() for _ in range(12))
    rows = []
    for i in range(n):
        if rows and random.random() < 0.6:
            w = random.choice(rows)[1].split(" ")
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(random.randint(1, 60))]
        rows.append((1000 * (seed + 1) - i, " ".join(w) if random.random() < 0.8 else " ".join(w) + " " + line))
    return rows


def long_rows():
    """Two near copies of a megabyte of words, and one that shares less than the bound."""
    w = [str(i) for i in range(170_000)]
    return [(90_001, " ".join(w)), (90_000, " ".join(w[:-9_000])), (90_002, " ".join(w[:120_000] + [x + "b" for x in w[120_000:]]))]


def test_ngram_join(spark, monkeypatch):
    rows = EDGES + [(5, "another text of the same id than above"), (9, "another text of the same id than above")] + long_rows()
    for seed in range(5):
        rows += near_rows(seed)
    want = join_reference(rows)
    found = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert found(ngram_join.ngram_join(docs(spark, rows))) == want
    for name, value in (("SALT_ROWS", 2), ("BLOCK", 4), ("BROADCAST_IDS", 0), ("BROADCAST_BYTES", 0), ("PAIRS_AT_ONCE", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(components, "TASK_LINKS", 40)
    assert found(ngram_join.ngram_join(docs(spark, rows))) == want
    assert found(ngram_join.ngram_join(docs(spark, rows), digest_bits=6)) == want  # most first digests stand for several sets


def test_salted_lists_stay_open_across_buckets(monkeypatch):
    """Rows of a salted list that are alone in their bucket meet the others as open rows."""
    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "SALT_ROWS", 2)
    cells = np.zeros(ngram_join.CELLS, np.uint32)
    h, node = np.array([5 << 40, 6 << 40], np.uint64), np.arange(1, 13)
    cells[0] = 40  # both shingles are in the first cell
    order = ngram_join.Order(cells)
    doc = np.repeat(np.arange(12), 2)
    batch = ngram_join.packs(node, np.full(12, 8), doc, np.tile(h, 12), np.zeros(24, np.int64), order, 97)
    assert batch.num_rows > 12 and max(len(x) for x in batch.column(1).to_pylist()) <= 8 * 8  # spread over buckets
    shared = type("Shared", (), {"value": cells})
    found = [r for b in ngram_join._lists(shared, ngram_join.ShingleFilters(75))([batch]) for r in pa.Table.from_batches([b]).to_pylist()]
    for token in {r["token"] for r in found}:
        assert sorted(r["node"] for r in found if r["token"] == token and r["open"]) == node.tolist()
    assert len({r["token"] for r in found}) == 2


def test_drop_near_copies(spark):
    rows = EDGES + near_rows(7, 40)
    clash = docs(spark, rows).withColumn("component_id", F.lit(1)).withColumn("id", F.lit("x")).withColumn("node", F.lit(2))
    out = ngram_join.drop_near_copies(clash)
    assert out.columns == clash.columns
    assert {r["doc_id"] for r in out.collect()} == {c for _, _, c in join_reference(rows)}
    assert ngram_join.ngram_join(docs(spark, [])).count() == 0


def test_order_does_not_depend_on_batches():
    """Lists in batches cut anywhere give the pairs of one batch."""
    import pyarrow as pa

    random.seed(5)
    words = [[random.choice("abcdefgh") for _ in range(40)] for _ in range(12)]
    doc, h = sh.shingle_sets([" ".join(w).encode() for w in words])
    n = np.bincount(doc, minlength=12)
    bits = ngram_join.bitmaps(doc, h, n).to_pylist()
    rows = [(t, 0, 0, 0, int(n[i]), 0, i, i, bits[i]) for t in range(5) for i in range(12) if (i + t) % 3]
    names = ["token", "a", "b", "own", "n", "place", "node", "component", "bits"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
    run = lambda cuts: {tuple(x.values()) for b in ngram_join._open_pairs(ngram_join.ShingleFilters(1), True)([batch.slice(i, j - i) for i, j in zip([0, *cuts], [*cuts, len(rows)])]) for x in b.to_pylist()}
    assert {p[1:] for p in run([])} == {p[1:] for p in run([3, 4, 4, 19, 30])} and run([])


def test_bitmaps_bound_the_difference():
    random.seed(6)
    for size in (1, 3, 64, 65, 200, 1000):
        own = [str(random.random()) for _ in range(size + 4)]
        other = own[: -max(1, size // 6)] + [str(random.random()) for _ in range(size // 9)]
        doc, h = sh.shingle_sets([" ".join(w).encode() for w in (own, other)])
        n = np.bincount(doc, minlength=2)
        differ = ngram_join.Bitmaps(n, ngram_join.bitmaps(doc, h, n).to_pylist()).differ(np.array([0]), np.array([1]))
        assert differ[0] <= len(set(h[doc == 0].tolist()) ^ set(h[doc == 1].tolist()))


def test_shingles_match_sets():
    texts = [None, b"", b" ", b"a b", b"A\x0bB", b"a b c d e f a b c d e f", "\x85é ü x y z".encode()]
    doc, h = sh.shingle_sets(texts)
    sets = [frozenset(h[doc == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(shingle_reference(t.decode() if t else t)) for t in texts]
    assert sets[3] == sets[4]
    assert list(sh.slices([b"x" * 10] * 5, 25)) == [(0, 2), (2, 4), (4, 5)]


# suffix-array deduplication -----------------------------------------------------


def suffix_reference(rows):
    least = {}
    rows = [(i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for x in range(len(t) - 49 if i is not None else 0):
            s = t[x : x + 50]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for x in range(len(t) - 49 if i is not None else 0):
            if least[t[x : x + 50]] < i:
                gone[x : x + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((str(i), len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 20, 1500])
def test_suffix_dedup(spark, shard, monkeypatch):
    random.seed(5)
    parts = ["".join(random.choice("abé ") for _ in range(random.choice([30, 49, 50, 51, 90, 200]))) for _ in range(15)]
    rows = [r for r in EDGES if r[0] != 7] + [(10 + i, "".join(random.choice(parts)[random.randint(0, 4) :] for _ in range(random.randint(1, 5)))) for i in range(120)]
    rows += [(500, "ab" * 300), (501, "ab" * 200), (501, "ab" * 90), (502, parts[4] * 20)]
    if shard < 1 << 20:
        monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 100)
        monkeypatch.setattr(suffix_dedup, "BROADCAST_IDS", 0)
    got = suffix_dedup.suffix_dedup(docs(spark, rows), shard_bytes=shard).collect()
    assert sorted((str(r[0]), r[1], r[2], len(r[3]), r[4]) for r in got) == suffix_reference(rows)


def test_suffix_array_and_prefixes():
    random.seed(6)
    data = np.frombuffer(bytes(random.choice(b"ab\0") for _ in range(900)), np.uint8)
    sizes = np.array([90] * 10)
    starts = np.cumsum(sizes) - sizes
    order = suffix_dedup.suffix_array(data, np.repeat(starts + sizes, sizes))
    raw = data.tobytes()
    rest = [raw[i : (i // 90 + 1) * 90] for i in range(900)]
    cut = [x.ljust(90, b"\0")[:64] for x in rest]
    assert all(cut[a] <= cut[b] for a, b in zip(order, order[1:]))
    lcp = suffix_dedup.common_prefixes(data, order, starts, sizes)
    for k in range(1, 900):
        x, y = rest[order[k]], rest[order[k - 1]]
        n = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert lcp[k] == min(50, n)
    keys = np.array(sorted({(a % 7, a % 5) for a in range(20)}), np.uint64)
    wanted = np.array([[0, 0], [6, 4], [9, 9], [3, 1]], np.uint64)
    found = suffix_dedup.find_strings(keys, wanted)
    assert [tuple(keys[i]) if i >= 0 else None for i in found] == [tuple(w) if tuple(w) in set(map(tuple, keys)) else None for w in wanted]


# personal data ------------------------------------------------------------------


def pii_reference(t):
    t, out = t or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_matches_brute_force():
    random.seed(7)
    bits = ["a@b.c", "x.y+z@mail-1.example.com", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (858) 555-7280", "+12", ".", "-", " ", "5", "é", "a@b", "@c.d", "\n", "1.2.3.4.5.6.7.8", "255"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 14))) for _ in range(4000)] + ["9" * 5000 + "." + "9" * 5000, "a" * 50_000 + "@", "1." * 20_000]
    for t in texts:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE] == pii_reference(t), t[:200]


def test_pii_added_kinds(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01"), (3, "part 123-45-6789"), (2, None)]
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["spans"]] for r in pii.pii_spans(docs(spark, rows)).collect()}
    assert [k for k, _ in got[1]] == ["iban"] and got[1][0][1] == pytest.approx(1.0)
    assert [k for k, _ in got[3]] == []
    assert pii.luhn("4111111111111111") and pii.mod97("GB82WEST12345698765432")
    assert [s[0] for s in pii.find_spans("my ssn is 123-45-6789")] == ["ssn"] and not pii.find_spans("part 123-45-6789")
    assert [s[0] for s in pii.find_spans("call 858-555-7280")] == ["local_phone"]


# SentencePiece ------------------------------------------------------------------


def test_sentencepiece_equals_library_and_round_trips(spark):
    import sentencepiece

    random.seed(8)
    texts = ["", "  Hello  wörld\n\tx y 😀 ", "a\x00b", "日本語テスト   mixed  ", "a" * 3000, "def f(x):\n        return x\n\n\n", "1234567890 " * 3]
    texts += ["".join(random.choice("abcdefghilmnorstu  .,;()\n=-é日0123") for _ in range(random.randint(1, 60))) for _ in range(300)]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model())
    for t in texts:
        ids = fst.encode(t).tolist()
        assert ids == library.encode(t)
        assert fst.decode(ids) == t
    frame = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(None, None)]).withColumnRenamed("n_chars", "n_tokens")
    out = sentencepiece_fst.decode(sentencepiece_fst.encode(frame)).collect()
    assert all((r["text"] or "") == r["decoded"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out) and len(out) == len(texts) + 1


def test_unigram_shortest_path_is_the_best_of_all():
    pieces = [("<unk>", 0.0, 2), *((p, s, 1) for p, s in (("▁", -2.0), ("a", -3.0), ("b", -3.5), ("ab", -4.0), ("▁a", -4.5), ("ba", -5.0), ("bab", -6.0)))]
    fst = sentencepiece_fst.Transducer({"bpe": False, "prefix": True, "pieces": pieces})

    def best(s):
        if not s:
            return 0.0
        return max((fst.scores[fst.ids[s[:k]]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in fst.ids), default=-1e9)

    for n in range(1, 8):
        for t in map("".join, itertools.product("ab", repeat=n)):
            assert sum(fst.scores[i] for i in fst.encode(t)) == pytest.approx(best("▁" + t))


# mixing -------------------------------------------------------------------------


def test_mixing_meets_weights_and_limits(spark):
    random.seed(9)
    rows = [(i, " ".join(["w"] * random.randint(0, 9)), None, random.choice(["a"] * 6 + ["b", "b", "c", None]), 1) for i in range(600)]
    frame = docs(spark, rows).withColumnRenamed("lang", "mix_tokens").withColumn("mix_order", F.lit("x"))
    out = mixing.mix(frame, block_tokens=64).collect()
    tokens, emitted, copies = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, t, _, s, _ in rows:
        tokens[s] += max(1, len(t.split()))
    for r in out:
        emitted[r["source"]] += r["mix_tokens"]
        copies[r["doc_id"]] += 1
    assert set(copies) == {r[0] for r in rows} and max(copies.values()) <= 2
    weights = {r["source"]: r["mix_weight"] for r in out}
    assert sum(weights.values()) == pytest.approx(1.0)
    repeat = {s: emitted[s] / tokens[s] for s in tokens}
    assert max(repeat.values()) <= 1.25 + 1e-6 and min(repeat.values()) == 1.0
    budget = max(tokens[s] / weights[s] for s in tokens)
    for s in tokens:
        assert weights[s] * budget - 10 <= emitted[s] <= weights[s] * budget + 1
    again = mixing.mix(frame.repartition(5), block_tokens=64).collect()
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in again) == sorted((r["doc_id"], r["mix_epoch"]) for r in out)
    half = mixing.mix(frame, budget_tokens=sum(tokens.values()) // 2, max_repetition=None, target_entropy=1.0, block_tokens=64).collect()
    assert sum(r["mix_tokens"] for r in half) <= sum(tokens.values()) // 2 + 3
    w = {r["source"]: r["mix_weight"] for r in half}
    assert -sum(x * np.log(x) for x in w.values()) == pytest.approx(1.0, abs=1e-3)
    assert mixing.mix(docs(spark, [])).count() == 0


# language identification --------------------------------------------------------


def test_language_gradient_and_accuracy(spark):
    rng = np.random.default_rng(0)
    w, x, y = language_id.init_weights(3), rng.integers(0, 256, (4, 7)), np.array([0, 1, 2, 0])
    mask = np.ones((4, 7))
    mask[1, 4:] = 0
    loss, grad = language_id.loss_and_gradient(w, x, mask, y)
    for k in w:
        i = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        moved = {a: b.copy() for a, b in w.items()}
        moved[k][i] += 1e-5
        assert (language_id.loss_and_gradient(moved, x, mask, y)[0] - loss) / 1e-5 == pytest.approx(grad[k][i], rel=1e-3, abs=1e-6)
    found = language_id.op10_language_id(spark, "/root/testdata/sf0.001").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = [r for r in found if r["held_out"]]
    assert len(found) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_language_edges(spark):
    w, languages = language_id.init_weights(2), ["aa", "bb"]
    frame = docs(spark, [*EDGES, (9, "123 !!")]).withColumnRenamed("source", "lang_pred").withColumn("lang_score", F.lit("x"))
    out = {(r["doc_id"], r["text"]): r for r in language_id.identify(frame, w, languages).collect()}
    assert all(out[i, t]["lang_pred"] == "und" and out[i, t]["lang_score"] == 0 for i, t in [(1, None), (2, ""), (3, "  \n"), (9, "123 !!")])
    assert out[7, "x" * 50_000]["lang_pred"] in languages
    assert language_id.fit(frame) == (None, [])
    assert {r["lang_pred"] for r in language_id.identify(frame, None, []).collect()} == {"und"}
    assert language_id.identify(frame, w, languages, pred="p", score="q").columns == [*frame.columns, "p", "q"]


def test_language_learns_from_the_whole_text_and_rare_languages(spark):
    """Words of the language stand behind 30,000 digits; one language has two rows of 400."""
    random.seed(3)
    speak = {"aa": "abacad", "bb": "xyzwvu", "cc": "klmnop"}
    text = lambda lang: " ".join("".join(random.choice(speak[lang]) for _ in range(5)) for _ in range(60))
    rows = [(i, "1234567890" * 3000 + text(lang) * 200, lang) for i, lang in enumerate(["aa"] * 40 + ["bb"] * 40)] + [(100 + i, text("aa"), "aa") for i in range(300)] + [(900, text("cc"), "cc"), (901, text("cc"), "cc")]
    w, languages = language_id.fit(docs(spark, rows))
    assert languages == ["aa", "bb", "cc"]
    tried = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb"] * 10)]
    out = language_id.identify(docs(spark, tried), w, languages).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.9


def test_windows_do_not_depend_on_batches():
    model = language_id.Labeller(language_id.init_weights(3))
    raw = [b"abc" * 50, b"x", bytes(range(32, 120)) * 3]
    sizes = np.array([len(r) for r in raw])
    both = model.documents(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for r, p in zip(raw, both):
        assert model.documents(np.frombuffer(r, np.uint8), np.array([0]), np.array([len(r)]))[0] == pytest.approx(p, abs=1e-5)


# toxicity -----------------------------------------------------------------------


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 5, 1])
    emit, move, start = rng.random((9, 2)) + 0.1, rng.random((2, 2)) + 0.1, rng.random(2) + 0.1
    alpha, beta, norm = toxicity.forward_backward(emit, sizes, move, start)
    gamma = alpha * beta / (alpha * beta).sum(1, keepdims=True)
    at, total = 0, 0.0
    for n in sizes[sizes > 0]:
        z, q = 0.0, np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            v = start[path[0]] * np.prod([emit[at + i, s] for i, s in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            z += v
            for i, s in enumerate(path):
                q[i, s] += v
        assert gamma[at : at + n] == pytest.approx(q / z)
        at, total = at + n, total + np.log(z)
    assert norm == pytest.approx(total)


def test_toxicity_held_out(spark):
    random.seed(10)
    plain = lambda: " ".join(random.choice("the of and to in is was for with on".split()) if random.random() < 0.5 else "w" + random.choice("abcdefgh") + random.choice("xyz") for _ in range(random.randint(3, 40)))
    texts, labels = [], []
    for i in range(600):
        t, y = plain(), int(i % 6 == 0)
        if y:
            w = t.split()
            w.insert(random.randrange(len(w)), random.choice(["Blarg", "zonk", "zonkers", "zonky"]))
            t = " ".join(w)
        texts.append(t)
        labels.append(y)
    model = toxicity.train(texts[:400], labels[:400])
    score, spans = toxicity.score_texts(model, texts[400:])
    assert ((score >= 0.3).astype(int) == labels[400:]).mean() >= 0.98
    t, s = next((t, s) for t, s, y in zip(texts[400:], spans, labels[400:]) if y and s)
    assert t[s[0][0] : s[0][1]].lower()[:4] in ("blar", "zonk")
    out = {(r["doc_id"], r["text"] if "text" in r else None): r["score"] for r in toxicity.score(docs(spark, EDGES), model).collect()}
    assert all(0 <= v < 0.3 for v in out.values()) and len(toxicity.score(docs(spark, []), model).collect()) == 0
    assert toxicity.train([], []) == {"share": 0.0} and toxicity.score_texts({"share": 0.25}, [None])[0][0] == 0.25


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert ngram_join.ngram_join(none).count() == 0 and suffix_dedup.suffix_dedup(none).count() == 0
    assert pii.pii_spans(none).count() == 0 and sentencepiece_fst.encode(none).count() == 0


def test_inputs_are_cut_where_no_piece_spans():
    """Marks beside a word make no other word of it, and the parts' ids are those of the whole text."""
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.read_model())
    text = "the house, the house. (the house!) the\nhouse  .. été1 据x\ty—the house…"
    whole = "▁" + text.replace(" ", "▁")
    assert "".join(fst.inputs(whole)) == whole
    assert fst.encode(text).tolist() == fst.shortest(whole)
    assert {w for w in fst.words if "house" in w} == {"▁house", "house"}
