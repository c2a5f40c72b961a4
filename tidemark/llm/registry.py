"""The queries of this subpackage and the SQL they are held against.

Queries without SQL are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from tidemark.llm import chat_format, html_extract, katz, license_scan, mixing, near_dedup, packing, quality_rules, vector_search, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_simhash": near_dedup.op4_simhash,
    "op5_katz": katz.op5_katz,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "op8_warc": warc.op8_warc,
    "op9_mixing": mixing.op9_mixing,
    "op10_top_k": vector_search.op10_top_k,
}

ORACLE_SQL = {
    "op2_chat_format": chat_format.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_top_k": vector_search.ORACLE,
}
