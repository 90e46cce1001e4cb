"""Queries and SQL of this package, for __spark_entry__.py."""

from __future__ import annotations

from . import alignment, exact_dedup, impact_search, language_id, line_dedup, mixing, ngram_join, packing, phrases, quality_lines, range_coder, url_filter, warc

MODULES = {
    "op1_warc": warc,
    "op2_language_id": language_id,
    "op3_mixing": mixing,
    "op4_line_dedup": line_dedup,
    "op5_exact_dedup": exact_dedup,
    "op6_ngram_join": ngram_join,
    "op7_packing": packing,
    "op8_url_filter": url_filter,
    "op9_range_coder": range_coder,
    "op10_quality_lines": quality_lines,
    "op11_phrases": phrases,
    "op12_alignment": alignment,
    "op13_impact_search": impact_search,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict:
    return {name: m.SQL for name, m in MODULES.items() if getattr(m, "SQL", None)}
