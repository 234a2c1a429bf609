"""Queries of this subpackage by name, and SQL for those that it can express."""

from __future__ import annotations

from . import ann, bpe, html, language, licenses, linededup, mixing, quality, simhash, urls

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_nearest_neighbours": ann.op3_nearest_neighbours,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_url_filter": urls.op5_url_filter,
    "op6_html_extraction": html.op6_html_extraction,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_language_id": language.op9_language_id,
    "op10_line_dedup": linededup.op10_line_dedup,
}

ORACLE_SQL = {"op4_license_scan": licenses.oracle(), "op5_url_filter": urls.OP5_SQL}
