"""Classifiers that must learn from whole texts."""

import random

from kinetrail.llm import toxicity


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(3)
    filler = [f"{a}{b}ra" for a in "bdfgklmnprst" for b in ("ab", "ed", "il", "on", "us")]
    text = lambda n, end: " ".join([*rng.choices(filler, k=n), *end])
    rows = [(i, text(1500, ["zorgul", "blattek"] if i % 2 else []), i % 2) for i in range(80)]
    assert min(len(t) - len("zorgul blattek") for _, t, _ in rows) > 6000
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    bad, clean = text(1500, ["zorgul", "blattek"]), text(6000, [])
    score, spans = toxicity.score_texts(model, [bad, clean])
    assert [bad[a:b] for a, b, _ in spans[0]] == ["zorgul", "blattek"] and spans[1] == []
    assert score[0] > 0.5 > toxicity.PREDICT > score[1]
