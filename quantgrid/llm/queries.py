"""Registered queries of the text operators."""

from __future__ import annotations

from quantgrid.llm import bpe, credentials, idfiles, jaccard, lines, merkle, outliers, packing, privacy, quality, syncmers, topk, variants

QUERIES = {
    f.__name__: f
    for f in (
        syncmers.op1_closed_syncmers,
        privacy.op2_weak_supervision_pii,
        lines.op3_levelled_line_dedup,
        quality.op4_bradley_terry_quality,
        bpe.op5_prefix_bpe,
        idfiles.op6_context_mixing_files,
        outliers.op7_mcd_quality_rules,
        jaccard.op8_chosen_path_join,
        packing.op9_best_fit_packing,
        credentials.op10_window_entropy_secrets,
        variants.op11_asymmetric_chunk_variants,
        topk.op12_no_random_access_top_k,
        merkle.op13_merkle_manifest,
    )
}

ORACLES = {
    "op3_levelled_line_dedup": lines.OP3_SQL,
    "op11_asymmetric_chunk_variants": variants.OP11_SQL,
    "op12_no_random_access_top_k": topk.OP12_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
