"""Alignment of two tokenizers against both libraries and a plain double loop."""

import hashlib
from collections import Counter

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinetrail.llm import alignment

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  two  blanks ", "\n\nlines \n x\t", "don't we'll <|endoftext|> <s>x</s>", "naïve 中文 \U0001f600​", "a\u2581b", "▁", "x  y", "0123 456.78", "\x00\x1c z", "same words same words", "same words same words", "w" * 5000 + " " + "é" * 3000]


def tokens_of(texts):
    a, b = Tokenizer.from_file(alignment.MODEL_A), sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)
    a.encode_special_tokens = True
    own = alignment.byte_characters()
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        ea, eb = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(own[c] for c in a.id_to_token(i)) for i in ea]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
        whole = (" " + t).encode()
        out.append((list(zip(ea, map(len, ba))), list(zip(eb, map(len, bb)))) if b"".join(ba) == whole == b"".join(bb) else None)
    return out


def plain(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, sha) by loops over the bytes."""
    docs = []
    for pair in tokens_of(texts):
        if pair is None:
            docs.append(None)
            continue
        spans = []
        for side in pair:
            at, own = 0, []
            for i, n in side:
                own.append((i, at, at + n))
                at += n
            spans.append(own)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, left = [], [list(reversed(side)) for side in spans]
        for hi in cuts:
            own = [[], []]
            for ids, side in zip(own, left):
                while side and side[-1][1] < hi:
                    ids.append(str(side.pop()[0]))
            groups.append("|".join(map(",".join, own)))
        links, at = [], 0  # both are in order: b moves along with a
        for i, s, e in spans[0]:
            while spans[1][at][2] <= s:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        docs.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in docs if d for x in d[3])
    most = {}
    for (a, b), c in count.items():
        most[b] = max(most.get(b, 0), c)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(count[x] == most[x[1]] for x in d[3]), sum(count[x] for x in d[3]), d[4]) for d in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_plain_loops_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r[0] for r in docs), plain([r[1] for r in docs])))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.op11_alignment(spark, SMALL).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 10_000


def test_odd_texts_repeats_and_both_ways_to_the_counts(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)] + [(1, "one id twice", "y"), (1, "one id twice", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    want = sorted(zip([-1 if r[0] is None else r[0] for r in rows], plain([r[1] for r in rows])))
    for most in (10**6, 0):
        out, pairs = alignment.align(docs, broadcast_pairs=most)
        assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(r[c] for c in COLUMNS)) for r in out.collect()) == want
        assert pairs.selectExpr("sum(links)").first()[0] == sum(w[1][3] for w in want)
    empty = alignment.align(docs.limit(0))[0]
    assert empty.collect() == [] and empty.columns == ["doc_id", *COLUMNS]


def test_a_long_text_without_a_blank_and_one_of_many_words(spark):
    texts = ["ab1!" * 30_000, " ".join(f"word{i % 977}" for i in range(20_000))]
    got = alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))[0].orderBy("doc_id").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == plain(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z9'.\n\t 　▁é中\u001c\U0001f600 ")), max_size=30), min_size=1, max_size=4))
def test_pieces_are_independent(texts):
    own = _ALIGNER.of(texts)
    for t, e, pair in zip(texts, own, tokens_of(texts)):
        assert (e is None) == (pair is None), t
        if e:
            assert (e[1], e[2]) == (len(pair[0]), len(pair[1])), t


def test_groups_break_where_both_end():
    a, b = np.array([2, 5, 9, 12]), np.array([3, 5, 12])
    assert alignment.coalesced(a, b).tolist() == [0, 0, 1, 1, 0, 0, 1]
    x, y = alignment.overlaps(a, b)
    assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]


_ALIGNER = alignment.Aligner(open(alignment.MODEL_A, "rb").read(), open(alignment.MODEL_B, "rb").read())
