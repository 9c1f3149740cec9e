"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from millrace.llm import decontaminate, html_extract, jaccard_join, lexical_search, markov_lm, quality, secret_scan, sentencepiece_codec, substring_dedup, token_alignment, token_counts, url_filter, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_warc": warc.op2_warc,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_lm_scoring": markov_lm.op11_lm_scoring,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = {
    "op2_warc": warc.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_quality_rules": quality.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op13_lexical_search": lexical_search.SQL,
}
