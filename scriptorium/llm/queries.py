"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import backoff_lm, bpe_automaton, decontaminate, language_id, pii, quality_crf, repeats, sharding, simhash_dedup, token_files

QUERIES = {
    "op10_difference_cover_repeats": repeats.op10,
    "op1_stupid_backoff_lm": backoff_lm.op1,
    "op4_weak_supervision_pii": pii.op4,
    "op2_simhash_decontamination": decontaminate.op2,
    "op9_kneser_ney_language": language_id.op9,
    "op3_quality_crf": quality_crf.op3,
    "op5_token_files": token_files.op5,
    "op6_virtual_slots": sharding.op6,
    "op7_bpe_automaton": bpe_automaton.op7,
    "op8_simhash_near_dedup": simhash_dedup.op8,
}

ORACLE_SQL: dict[str, str] = {
    "op1_stupid_backoff_lm": backoff_lm.SQL,
}
