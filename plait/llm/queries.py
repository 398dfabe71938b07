"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from plait.llm import decontaminate, html_extract, jaccard_join, language_id, line_dedup, piece_sampler, pipeline, quality_model, quality_rules, secret_scan, url_filter


def queries() -> dict:
    return {
        "op1_piece_sampler": piece_sampler.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_html_extract": html_extract.query,
        "op4_language_id": language_id.query,
        "op5_secret_scan": secret_scan.query,
        "op6_decontaminate": decontaminate.query,
        "op7_url_filter": url_filter.query,
        "op8_line_dedup": line_dedup.query,
        "op9_quality_rules": quality_rules.query,
        "op10_quality_model": quality_model.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secret_scan": secret_scan.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
    }
