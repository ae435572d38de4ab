"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ledgerlark.llm import (
    alignment, byte_bpe, clustering, decontamination, licenses, near_documents, near_lines, packing, pages, quality, repeats, sharding, toxicity,
)

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_suffix_array_dedup": repeats.op2_suffix_array_dedup,
    "op3_page_differencing": pages.op3_page_differencing,
    "op4_minhash_near_dedup": near_documents.op4_minhash_near_dedup,
    "op5_bounded_packing": packing.op5_bounded_packing,
    "op6_lexicon_toxicity": toxicity.op6_lexicon_toxicity,
    "op7_fuzzy_line_dedup": near_lines.op7_fuzzy_line_dedup,
    "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
    "op9_weak_supervision": quality.op9_weak_supervision,
    "op10_suffix_array_decontamination": decontamination.op10_suffix_array_decontamination,
    "op11_cross_tokenizer_alignment": alignment.op11_cross_tokenizer_alignment,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}

SQL = {
    "op4_minhash_near_dedup": near_documents.SQL,
    "op8_rendezvous_sharding": sharding.SQL,
    "op10_suffix_array_decontamination": decontamination.SQL,
    "op13_centroid_clustering": clustering.SQL,
}
