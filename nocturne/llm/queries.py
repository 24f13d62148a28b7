"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import balltree, bytebpe, linededup, lm, lpf, minhash, mixing, rptree, tokencount, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_near_vectors": rptree.op2_near_vectors,
        "op3_top_k": balltree.op3_top_k,
        "op4_mixing": mixing.op4_mixing,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_lm_score": lm.op6_lm_score,
        "op7_byte_bpe": bytebpe.op7_byte_bpe,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_repeats": lpf.op9_repeats,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": balltree.OP3_SQL, "op4_mixing": mixing.OP4_SQL, "op5_line_dedup": linededup.OP5_SQL}
