"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embeddings, exact_dedup, filter_audit, hard_negatives, mixing, packing, quality, secrets, sharding, simhash, suffix_dedup, suffix_tree, toxicity

QUERIES = {
    "op1_suffix_tree": suffix_tree.op1_suffix_tree,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_secrets": secrets.op3_secrets,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_repeats": suffix_dedup.op5_repeats,
    "op6_simhash": simhash.op6_simhash,
    "op7_near_vectors": embeddings.op7_near_vectors,
    "op8_shard": sharding.op8_shard,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_pack": packing.op10_pack,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_quality": quality.op12_quality,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
SQL = {"op9_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_filter_audit": filter_audit.SQL}
