"""Operators of a training-data pipeline, and the queries that apply them to the test tables."""

from . import bpe, chat, jaccard, langid, packing, pages, periodic, pii, quality, substring, topk, toxicity, variants

QUERIES = {
    f.__name__: f
    for f in (
        topk.op1_topk, jaccard.op2_ngram_jaccard, packing.op3_packing, chat.op4_chat_format, substring.op5_substring_dedup,
        quality.op6_quality, langid.op7_language_id, bpe.op8_byte_bpe, pii.op9_pii, toxicity.op10_toxicity, periodic.op11_periodic_runs,
        variants.op12_spelling_variants, pages.op13_page_text,
    )
}
ORACLES = {"op1_topk": topk.ORACLE, "op2_ngram_jaccard": jaccard.ORACLE, "op4_chat_format": chat.ORACLE, "op5_substring_dedup": substring.ORACLE, "op6_quality": quality.ORACLE, "op12_spelling_variants": variants.ORACLE}
