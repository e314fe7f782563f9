"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from . import bpe, decontaminate, exact_dup, lm_score, near_dup, prefix_trie, quality, secrets, token_counts, topk, toxicity, variants, warc

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        quality.op2_quality_weak_labels,
        lm_score.op3_lm_cross_entropy,
        near_dup.op4_minhash_near_dedup,
        bpe.op5_bpe_encode_decode,
        secrets.op6_secret_scan,
        toxicity.op7_toxicity_cnn,
        topk.op8_impact_ordered_topk,
        decontaminate.op9_benchmark_decontamination,
        warc.op10_warc_round_trip,
        exact_dup.op11_exact_dedup,
        prefix_trie.op12_conversation_prefix_trie,
        variants.op13_spelling_variants,
    )
}
ORACLE = {**topk.ORACLE, **decontaminate.ORACLE, **warc.ORACLE, **exact_dup.ORACLE, **prefix_trie.ORACLE, **variants.ORACLE}
