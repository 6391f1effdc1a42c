"""Registration of the operators' queries and of the SQL that expresses them."""

from __future__ import annotations

from . import op01_license, op02_quality, op03_sentencepiece, op04_topk, op05_lm, op06_packing, op07_simhash, op08_toxicity, op09_url_filter, op10_pii, op11_collocations, op12_sharding, op13_merkle
from .sql import ORACLE_SQL

QUERIES = {
    "op1_license": op01_license.op1_license,
    "op2_quality": op02_quality.op2_quality,
    "op3_sentencepiece": op03_sentencepiece.op3_sentencepiece,
    "op4_hamming_topk": op04_topk.op4_hamming_topk,
    "op5_lm_score": op05_lm.op5_lm_score,
    "op6_packing": op06_packing.op6_packing,
    "op7_simhash": op07_simhash.op7_simhash,
    "op8_toxicity": op08_toxicity.op8_toxicity,
    "op9_url_filter": op09_url_filter.op9_url_filter,
    "op10_pii": op10_pii.op10_pii,
    "op11_collocations": op11_collocations.op11_collocations,
    "op12_sharding": op12_sharding.op12_sharding,
    "op13_merkle": op13_merkle.op13_merkle,
}

__all__ = ["QUERIES", "ORACLE_SQL"]
