"""The queries of this subpackage and, where SQL can express them, what DuckDB should return."""

from . import chat_format, exact_dedup, fill_middle, importance, language_id, lm_score, mixing, quality_rules, sentencepiece_codec, simhash_dedup, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_mixing": mixing.op10_mixing,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_importance": importance.op13_importance,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
    "op13_importance": importance.ORACLE,
}
