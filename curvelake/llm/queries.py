"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import bpe, chat, html_text, jpeg, license, mixing, neardup, packing, prefix_counts, quality, repair, runs, substrings


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_ngram_jaccard": neardup.op2_ngram_jaccard,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_html_text": html_text.op4_html_text,
        "op5_token_counts": prefix_counts.op5_token_counts,
        "op6_license_scan": license.op6_license_scan,
        "op7_jpeg_media": jpeg.op7_jpeg_media,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_source_mix": mixing.op9_source_mix,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_best_fit_packing": packing.op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.SQL, "op2_ngram_jaccard": neardup.SQL, "op3_substring_dedup": substrings.SQL, "op6_license_scan": license.SQL, "op8_quality_rules": quality.SQL}
