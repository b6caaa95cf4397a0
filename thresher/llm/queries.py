"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from . import decontaminate, jaccard, line_dedup, lm, pieces, sharding, substrings, token_files, toxicity, vectors

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_decontaminate": decontaminate.query,
    "op3_jaccard": jaccard.query,
    "op4_line_dedup": line_dedup.query,
    "op5_vectors": vectors.query,
    "op6_lm": lm.query,
    "op7_substrings": substrings.query,
    "op8_toxicity": toxicity.query,
    "op9_token_files": token_files.query,
    "op10_sharding": sharding.query,
}

ORACLES = {
    "op2_decontaminate": decontaminate.SQL,
    "op3_jaccard": jaccard.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_vectors": vectors.SQL,
    "op7_substrings": substrings.SQL,
}
