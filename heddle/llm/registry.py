"""Queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from . import decontaminate, hmm_score, line_dedup, mixing, nearest, ngram_join, pii, secrets, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_nearest_neighbours": nearest.op1_nearest_neighbours,
        "op2_ngram_jaccard": ngram_join.op2_ngram_jaccard,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_source_mixing": mixing.op6_source_mixing,
        "op7_pii": pii.op7_pii,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_hmm_score": hmm_score.op10_hmm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_nearest_neighbours": nearest.OP1_SQL,
        "op2_ngram_jaccard": ngram_join.OP2_SQL,
        "op4_decontamination": decontaminate.OP4_SQL,
        "op5_secret_scan": secrets.OP5_SQL,
        "op7_pii": pii.OP7_SQL,
    }
