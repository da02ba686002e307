"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from opsmill.llm import (
    bpe,
    context_tree,
    decontamination,
    exact_dedup,
    extraction,
    minhash,
    negatives,
    pii,
    quality,
    sharding,
    toxicity,
    warc,
    whitening,
)

QUERIES = {
    "op1_minhash_forest": minhash.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_decontamination": decontamination.op3,
    "op4_toxicity": toxicity.op4,
    "op5_html_wrappers": extraction.op5,
    "op6_context_tree": context_tree.op6,
    "op7_warc_bundles": warc.op7,
    "op8_pii_disclosure": pii.op8,
    "op9_byte_shards": sharding.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_hard_negatives": negatives.op11,
    "op12_whitening": whitening.op12,
    "op13_quality_neighbours": quality.op13,
}

ORACLES = {
    "op1_minhash_forest": minhash.OP1_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op7_warc_bundles": warc.OP7_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
}
