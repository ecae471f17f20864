"""The training-data queries and their DuckDB oracles."""

from __future__ import annotations

from matchweave.llm import alignment, decontaminate, embedding_dedup, html_text, lexical, line_dedup, mixing, pieces, pii, simhash, substrings, toxicity, url_rules

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_substrings": substrings.op3_substrings,
    "op4_pii": pii.op4_pii,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_text": html_text.op10_html_text,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES: dict[str, str] = {
    "op5_url_rules": url_rules.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
