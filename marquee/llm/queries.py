"""The registered queries of the subpackage and the SQL that states their results."""

from __future__ import annotations

from marquee.llm import arc_convert, bottomk, license_join, merkle_manifest, norm_topk, prefix_trie, quality_cascade, subspace_join, suffix_spans, unigram, vector_pack, weak_quality, winnow_lines

QUERIES = {
    "op1_arc_convert": arc_convert.op1_arc_convert,
    "op2_bottomk": bottomk.op2_bottomk,
    "op3_quality_cascade": quality_cascade.op3_quality_cascade,
    "op4_unigram": unigram.op4_unigram,
    "op5_weak_quality": weak_quality.op5_weak_quality,
    "op6_license_join": license_join.op6_license_join,
    "op7_norm_topk": norm_topk.op7_norm_topk,
    "op8_winnow_lines": winnow_lines.op8_winnow_lines,
    "op9_suffix_spans": suffix_spans.op9_suffix_spans,
    "op10_vector_pack": vector_pack.op10_vector_pack,
    "op11_subspace_join": subspace_join.op11_subspace_join,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}
SQL = {
    "op3_quality_cascade": quality_cascade.SQL,
    "op7_norm_topk": norm_topk.SQL,
    "op8_winnow_lines": winnow_lines.SQL,
    "op11_subspace_join": subspace_join.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_merkle_manifest": merkle_manifest.SQL,
}
