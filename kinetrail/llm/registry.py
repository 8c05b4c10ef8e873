"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from . import alignment, exact_dedup, language_id, maxscore, minhash, mixing, ngram_join, pii, sentencepiece_fst, suffix_dedup, topk, toxicity, warc

QUERIES = {
    "op1_topk_search": topk.op1_topk_search,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_pii": pii.op4_pii,
    "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
    "op6_mixing": mixing.op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_language_id": language_id.op10_language_id,
    "op11_alignment": alignment.op11_alignment,
    "op12_maxscore": maxscore.op12_maxscore,
    "op13_minhash": minhash.op13_minhash,
}
ORACLES = {
    "op1_topk_search": topk.ORACLE,
    "op2_ngram_join": ngram_join.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op12_maxscore": maxscore.ORACLE,
    "op13_minhash": minhash.ORACLE,
}
