"""The registered queries of the training-data operators."""

from __future__ import annotations

from . import block_max, divergence, hard_negatives, langid, line_dedup, media, mixing, packing, quality, secret_scan, simhash, token_counts, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_media_columns": media.op4_media_columns,
    "op5_quality": quality.op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": langid.op9_language_id,
    "op10_simhash": simhash.op10_simhash,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_exact_topk": block_max.op12_exact_topk,
    "op13_source_divergence": divergence.op13_source_divergence,
}

#: Where SQL can express the whole result.
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op11_hard_negatives": hard_negatives.ORACLE_SQL,
    "op12_exact_topk": block_max.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
