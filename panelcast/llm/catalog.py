"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from panelcast.llm import (ann, byte_bpe, exact_dedup, html_text, language_id, line_dedup, minhash_forest, mixing, periodic_runs, quality, toxicity,
                           url_filter, whitening)

QUERIES = {
    "op1_minhash_forest": minhash_forest.op1_minhash_forest,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_html_text": html_text.op4_html_text,
    "op5_ann": ann.op5_ann,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_mix": mixing.op7_mix,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality": quality.op10_quality,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_whitening": whitening.op13_whitening,
}

SQL = {
    "op1_minhash_forest": minhash_forest.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_mix": mixing.SQL,
    "op8_url_filter": url_filter.SQL,
    "op11_line_dedup": line_dedup.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
}
