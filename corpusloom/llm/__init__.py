"""Operators of a training-data pipeline over whole document collections."""

from __future__ import annotations


def queries() -> dict:
    from corpusloom.llm import chunks, decontaminate, language, licenses, mixing, prefix_trie, quality, ranked_search, simhash, suffixes, surrogates, token_counts, warc

    found = (
        licenses.op1_license_scan,
        quality.op2_quality_rules,
        token_counts.op3_count_tokens,
        mixing.op4_mix_sources,
        language.op5_language_id,
        suffixes.op6_suffix_dedup,
        chunks.op7_substring_dedup,
        simhash.op8_simhash_near_dedup,
        decontaminate.op9_decontaminate,
        surrogates.op10_pii_surrogates,
        ranked_search.op11_ranked_search,
        prefix_trie.op12_prefix_trie,
        warc.op13_warc,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from corpusloom.llm import mixing, prefix_trie, quality, ranked_search, warc

    return {"op2_quality_rules": quality.OP2_SQL, "op4_mix_sources": mixing.OP4_SQL, "op11_ranked_search": ranked_search.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL, "op13_warc": warc.OP13_SQL}
