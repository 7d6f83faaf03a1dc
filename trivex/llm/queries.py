"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import langid, line_dedup, lsh_search, mixing, norm_search, packing, quality, simhash, suffix_dedup, token_store

QUERIES = {
    "op1_rank_order_langid": langid.op1,
    "op2_run_length_suffix_dedup": suffix_dedup.op2,
    "op3_kneser_ney_quality": quality.op3,
    "op4_simhash_deletion_variants": simhash.op4,
    "op5_sum_of_squares_packing": packing.op5,
    "op6_zstd_token_store": token_store.op6,
    "op7_multiprobe_lsh": lsh_search.op7,
    "op8_winnowing_line_dedup": line_dedup.op8,
    "op9_norm_bucketed_topk": norm_search.op9,
    "op10_systematic_mixing": mixing.op10,
}

SQL: dict[str, str] = {
    "op8_winnowing_line_dedup": line_dedup.SQL8,
    "op9_norm_bucketed_topk": norm_search.SQL9,
}
