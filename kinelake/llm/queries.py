"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .audit import OP12_SQL, op12_filter_audit
from .fingerprint import op7_paragraph_multiset_hash
from .hmm import op8_hidden_markov
from .levels import op13_sum_of_squares
from .manifest import OP11_SQL, op11_merkle_manifest
from .media import op6_avi_clips
from .mixing import op2_soft_mixing
from .neardup import op3_order_minhash
from .packing import op5_variable_best_fit
from .quality import op1_quality_fm
from .sharding import OP9_SQL, op9_rendezvous_shards
from .tokenids import op4_packed_ids
from .toxicity import op10_compression_toxicity

QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_soft_mixing": op2_soft_mixing,
    "op3_order_minhash": op3_order_minhash,
    "op4_packed_ids": op4_packed_ids,
    "op5_variable_best_fit": op5_variable_best_fit,
    "op6_avi_clips": op6_avi_clips,
    "op7_paragraph_multiset_hash": op7_paragraph_multiset_hash,
    "op8_hidden_markov": op8_hidden_markov,
    "op9_rendezvous_shards": op9_rendezvous_shards,
    "op10_compression_toxicity": op10_compression_toxicity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_filter_audit": op12_filter_audit,
    "op13_sum_of_squares": op13_sum_of_squares,
}
ORACLE_SQL: dict[str, str] = {"op9_rendezvous_shards": OP9_SQL, "op11_merkle_manifest": OP11_SQL, "op12_filter_audit": OP12_SQL}
