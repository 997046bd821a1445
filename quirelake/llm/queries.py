"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quirelake.llm import bpe, brown_lm, decontaminate, exact_dedup, filter_audit, language_id, ngram_join, quality, resampling, secrets, token_counts, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_language_id": language_id.op2_language_id,
    "op3_brown_lm": brown_lm.op3_brown_lm,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_bpe": bpe.op7_bpe,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_quality": quality.op10_quality,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_warc": warc.op13_warc,
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_importance_resampling": resampling.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
