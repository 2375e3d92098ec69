"""The registry of this folder: ``opN_<name>`` queries and their DuckDB SQL."""

from __future__ import annotations

from convspark.llm import (byte_bpe, collocations, decontam, exact_dedup, jaccard_join, licences, line_templates,
                           periodic_runs, quality, shard, spot_signatures, suffix_dedup, url_filter)

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_shards": shard.op5_shards,
    "op6_quality": quality.op6_quality,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_line_templates": line_templates.op8_line_templates,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_licences": licences.op10_licences,
    "op11_collocations": collocations.op11_collocations,
    "op12_spot_signatures": spot_signatures.op12_spot_signatures,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE = {**exact_dedup.ORACLE, **collocations.ORACLE}
