"""The queries of this subpackage and the SQL of those that SQL can express."""

from verdance.llm import chat, divergence, lines, mixing, neardup, packing, revisits, scoring, sharding, topk, toxicity, vectordup, whitening


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_sharding": sharding.op2_sharding,
        "op3_revisits": revisits.op3_revisits,
        "op4_mixing": mixing.op4_mixing,
        "op5_lm_scoring": scoring.op5_lm_scoring,
        "op6_vector_dedup": vectordup.op6_vector_dedup,
        "op7_packing": packing.op7_packing,
        "op8_topk": topk.op8_topk,
        "op9_near_dedup": neardup.op9_near_dedup,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_chat_trees": chat.op11_chat_trees,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict:
    return {
        "op2_sharding": sharding.ORACLE,
        "op3_revisits": revisits.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op8_topk": topk.ORACLE,
        "op10_line_dedup": lines.ORACLE,
        "op11_chat_trees": chat.ORACLE,
        "op12_source_divergence": divergence.ORACLE,
    }
