"""Queries and oracles of this subpackage; ``corpus_pipeline.py`` has its own."""

from stratadoc.llm import bpe, exact_dedup, media, mixing, near_dedup, pii, secret_scan, suffix_tree, toxicity, warc

QUERIES = {
    "op1_probminhash": near_dedup.op1_probminhash,
    "op2_jpeg_media": media.op2_jpeg_media,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_fair_mix": mixing.op4_fair_mix,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_warc_fixity": warc.op6_warc_fixity,
    "op7_pii": pii.op7_pii,
    "op8_suffix_tree": suffix_tree.op8_suffix_tree,
    "op9_bpe_round_trip": bpe.op9_bpe_round_trip,
    "op10_secret_ownership": secret_scan.op10_secret_ownership,
}
ORACLES = {"op4_fair_mix": mixing.ORACLE, "op5_exact_dedup": exact_dedup.ORACLE, "op6_warc_fixity": warc.ORACLE}
