"""The registered queries of the training-data operators and their SQL (``SQL``, where it can express them)."""

from __future__ import annotations

from . import (cover_dedup, lattice_lm, mixing, mph_dedup, parity_join, prefix_trie, quality, repeats, secret_scan, sharding, spm,
               warc, whitening)
from .oracles import SQL  # noqa: F401

QUERIES = {
    "op1_lattice_lm": lattice_lm.op1_lattice_lm,
    "op2_mph_exact_dedup": mph_dedup.op2_mph_exact_dedup,
    "op3_parity_sketch_join": parity_join.op3_parity_sketch_join,
    "op4_stratified_interleave": sharding.op4_stratified_interleave,
    "op5_agenda_sentencepiece": spm.op5_agenda_sentencepiece,
    "op6_capped_water_filling": mixing.op6_capped_water_filling,
    "op7_risk_controlled_rules": quality.op7_risk_controlled_rules,
    "op8_interval_tree_repeats": repeats.op8_interval_tree_repeats,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_warc_index_merge": warc.op10_warc_index_merge,
    "op11_zfast_conversation_trie": prefix_trie.op11_zfast_conversation_trie,
    "op12_qdwh_whitening": whitening.op12_qdwh_whitening,
    "op13_difference_cover_dedup": cover_dedup.op13_difference_cover_dedup,
}
