"""Queries of the training-data operators, by registered name."""

from __future__ import annotations

from . import divergence, jaccard, substring_dedup, topk_bsi
from .decontam import op5_benchmark_decontamination
from .divergence import op12_source_divergence
from .html_extract import op10_html_extraction
from .jaccard import op8_ngram_jaccard_join
from .line_dedup import op7_fuzzy_line_dedup
from .packing import op9_best_fit_packing
from .quality import op2_quality_classifier
from .rans import op6_token_files
from .sequenced import op13_sequenced_changes
from .sharding import op4_sharding
from .substring_dedup import op1_substring_dedup
from .token_counts import op11_token_counts
from .topk_bsi import op3_bit_sliced_top_k


def queries():
    found = [op1_substring_dedup, op2_quality_classifier, op3_bit_sliced_top_k, op4_sharding, op5_benchmark_decontamination, op6_token_files, op7_fuzzy_line_dedup, op8_ngram_jaccard_join, op9_best_fit_packing, op10_html_extraction]
    found += [op11_token_counts, op12_source_divergence, op13_sequenced_changes]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op1_substring_dedup": substring_dedup.ORACLE, "op3_bit_sliced_top_k": topk_bsi.ORACLE, "op8_ngram_jaccard_join": jaccard.ORACLE, "op12_source_divergence": divergence.ORACLE}
