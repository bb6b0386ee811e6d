"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from cloakfield.llm import embedding_dedup, fill_in_middle, harmonic_packing, html_extract, line_dedup, mixing, ngram_join, packing, pii_surrogates, quality_rules, sharding, source_divergence, url_filter


def queries():
    return {
        "op1_pii_surrogates": pii_surrogates.query,
        "op2_url_filter": url_filter.query,
        "op3_html_extract": html_extract.query,
        "op4_quality_rules": quality_rules.query,
        "op5_ngram_join": ngram_join.query,
        "op6_line_dedup": line_dedup.query,
        "op7_best_fit_packing": packing.query,
        "op8_source_mixing": mixing.query,
        "op9_embedding_dedup": embedding_dedup.query,
        "op10_sharding": sharding.query,
        "op11_fill_in_middle": fill_in_middle.query,
        "op12_source_divergence": source_divergence.query,
        "op13_harmonic_packing": harmonic_packing.query,
    }


def oracle_sql():
    return {
        "op4_quality_rules": quality_rules.ORACLE,
        "op5_ngram_join": ngram_join.ORACLE,
        "op6_line_dedup": line_dedup.ORACLE,
        "op8_source_mixing": mixing.ORACLE,
        "op9_embedding_dedup": embedding_dedup.ORACLE,
        "op11_fill_in_middle": fill_in_middle.ORACLE,
        "op12_source_divergence": source_divergence.ORACLE,
    }
