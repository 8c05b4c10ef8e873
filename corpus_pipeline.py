"""A training corpus from ``documents`` in five stages.

Language identification drops documents without a recognisable language, exact and
near deduplication keep one document of each group, mixing repeats documents of
small sources until the sources have their weights (no document is dropped: the
budget is the smallest in which each appears once), and encoding turns texts into
token ids. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_fst
from kinetrail.llm.common import Workspace, fold, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; without labels, all with a letter."""
    learn = docs.filter(F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    weights, languages = language_id.fit(learn)
    if weights is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.identify(docs, weights, languages, pred="__lang_pred", score="__lang_score")
    kept = found.filter((F.col("__lang_pred") != language_id.UND) & (F.col("__lang_score") >= language_id.MIN_SCORE))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, prefix="__mix_").select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(docs, keep_text=False)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]
#: The first stage is a trained network, so SQL cannot express the pipeline; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written before the next reads it."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = ws.write(docs, name)
            if i:
                ws.drop(STAGES[i - 1][0])
    return docs
